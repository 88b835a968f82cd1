"""A corpus pipeline of five stages; each reads what its predecessor kept, from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm import simhash
from faultloom.llm.common import table
from faultloom.llm.decontaminate import remove_contamination
from faultloom.llm.queries import TOKENIZERS, scratch
from faultloom.llm.secrets import redact_secrets
from faultloom.llm.sentencepiece_scan import encode, load_pieces
from faultloom.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity, training_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored THRESHOLD or more go."""
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    # the documents may have a column of any name, so the score gets one of its own
    own = max((*docs.columns, "score"), key=len) + "_toxic"
    scored = score_toxicity(docs, model, keep=tuple(docs.columns), score=own)
    return scored.filter(F.col(own) < THRESHOLD).drop(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return _measured(remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _measured(redact_secrets(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids."""
    # workers that ran the earlier stages are large already: a smaller memory of words
    pieces = load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model", room=50_000)
    found = encode(docs, pieces, keep=("lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"),
                        "token_ids", "round_trip")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]
# Scores, hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
