"""Token counts as rollups that signed deltas keep current."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import array, column, map_rows

# fixed value: how the public 50k byte-level vocabulary cuts text
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUP = ["source", "lang", "tokenizer"]
STATE = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, live boolean"


@cache
def _encoding(name: str, ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A row for each document and tokenizer version: id, source, lang, tokenizer, n_tokens.

    ``tokenizers`` maps a version to the path of its rank file, which the driver reads;
    tasks get it by broadcast. Null and empty texts have no tokens.
    """
    ranks = {}
    for name, path in tokenizers.items():
        with open(path, "rb") as file:
            ranks[name] = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = column(batch, "text")
        for name, content in shared.value.items():
            encode = _encoding(name, content).encode_ordinary
            yield {"doc_id": array(batch, "id"), "source": array(batch, "source"), "lang": array(batch, "lang"),
                   "tokenizer": [name] * len(texts), "n_tokens": [len(encode(t)) if t else 0 for t in texts]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")


class TokenRollup:
    """Additive totals by source, language and tokenizer version in a shared folder.

    ``states/batch=i`` holds what batch i said last about each document it touched,
    ``deltas/batch=i`` the signed change of the totals. A batch is committed once its
    delta folder has Spark's success mark; what a lost run left behind is overwritten by
    the next try, and a committed batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def committed(self) -> list[int]:
        """Committed batches in the order of their numbers."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        done = [p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done if n.startswith("batch="))

    def _states(self, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{STATE}, batch int")
        parts = [self.spark.read.schema(STATE).parquet(self._path("states", b)).withColumn("batch", F.lit(b))
                 for b in batches]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def apply(self, batch: int, counts: DataFrame, live: bool = True) -> bool:
        """Commit a batch; false if it was committed before.

        ``counts`` has the columns of ``count_tokens``: new or revised counts, or with
        ``live=False`` documents to delete (only ``doc_id`` and ``tokenizer`` count
        then). A row without an id is a document of its own, which no later batch can name:
        it is counted when it is inserted, and deleting it changes nothing. Several rows for one document and tokenizer are one change, by the
        greatest (n_tokens, source, lang), so a repeated row counts once. Deleting what is not there changes nothing.
        """
        before = self.committed()
        if batch in before:
            return False
        if before and batch < before[-1]:
            raise ValueError(f"batch {batch} is older than batch {before[-1]}")
        nameless = counts.filter(F.col("doc_id").isNull() & F.lit(live)).groupBy("source", "lang", "tokenizer").agg(
            F.sum("n_tokens").alias("tokens"), F.count("*").cast("int").alias("docs"))
        new = counts.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "tokenizer").agg(
            F.max(F.struct("n_tokens", "source", "lang")).alias("x")).select(
            "doc_id", "x.source", "x.lang", "tokenizer", "x.n_tokens", F.lit(live).alias("live"))
        new.write.mode("overwrite").parquet(self._path("states", batch))
        new = self._states([batch])
        key = ["doc_id", "tokenizer"]
        # the last word on each document this batch touches, itself left out
        both = self._states([*before, batch]).groupBy(*key).agg(
            F.max("batch").alias("top"),
            F.max(F.when(F.col("batch") < batch, F.struct("batch", "live", "source", "lang", "n_tokens"))).alias("old"))
        old = both.filter((F.col("top") == batch) & F.col("old.live")).select(
            "old.source", "old.lang", "tokenizer", (-F.col("old.n_tokens")).alias("tokens"), F.lit(-1).alias("docs"))
        fresh = new.filter("live").select("source", "lang", "tokenizer", F.col("n_tokens").alias("tokens"),
                                          F.lit(1).alias("docs"))
        delta = old.unionByName(fresh).unionByName(nameless).groupBy(*GROUP).agg(
            F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(self._path("deltas", batch))
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups whose
        documents have all gone are left out."""
        batches = self.committed()
        schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
        if not batches:
            return self.spark.createDataFrame([], schema.replace("docs", "n_docs").replace("tokens", "n_tokens"))
        rows = self.spark.read.schema(schema).parquet(*[self._path("deltas", b) for b in batches])
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter(
            "n_docs <> 0")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of rows whose text an earlier id has as well; null texts are no copies.

    The first id of every text is what one aggregate over marks of the texts gives, with
    partial sums; the rest is an anti-join by id, so a text that a third of all rows share
    is no single task. An id that is first for one of its texts is no copy.
    """
    marked = materialize(docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("mark")))
    first = marked.groupBy("mark").agg(F.min("id").alias("id")).select("id")
    return marked.select("id").join(first, "id", "left_anti").distinct().select(F.col("id").alias(id_col))
