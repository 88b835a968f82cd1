"""Language identification: sparse multinomial regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import array, column, map_rows

UNKNOWN = "und"
ORDERS = (1, 2, 3)    # lengths of the n-grams, each one more than the last
BITS = 14
BUCKETS = 1 << BITS
PER_LANGUAGE = 1_500      # training rows of a language, about, as many again to calibrate
SHARDS, EPOCHS = 4, 3     # learners whose weights are averaged, passes of each
RATE, SMOOTH, L1, L2 = 0.5, 1.0, 0.02, 0.05
TEMPERATURES = tuple(float(2.0 ** (k / 4)) for k in range(-24, 13))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_LETTERS = np.array([chr(cp).isalpha() for cp in range(0x3000)])


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other signs as one blank."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    # beyond the table a letter is asked for one by one, once a distinct sign
    ok = _LETTERS[np.minimum(cp, len(_LETTERS) - 1)]
    far = cp >= len(_LETTERS)
    if far.any():
        signs, at = np.unique(cp[far], return_inverse=True)
        ok = ok.copy()
        ok[far] = np.array([chr(c).isalpha() for c in signs])[at]
    if not ok.any():
        return np.zeros(0, dtype=np.uint32)
    first = ok.copy()
    first[1:] |= ok[:-1]  # of a run of other signs the first stays
    x = np.where(ok, cp, 32)[first]
    return np.concatenate(([32], x, [32])).astype(np.uint32)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of a text, and how often each occurs."""
    x = letters(text)
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    hashes = [x * _FACTORS[0]]
    for order in ORDERS[1:]:
        if len(x) >= order:
            hashes.append((hashes[-1][:-1] ^ x[order - 1:]) * _FACTORS[order - 1])
    h = np.concatenate(hashes)
    total = np.bincount((h >> np.uint32(32 - BITS)).astype(np.intp), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Texts that hold each bucket, over all rows, and the number of texts with letters;
    tasks combine first, so at most BUCKETS rows leave a task or reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in column(batch, "text"):
                at, _ = grams(text)
                total[at] += 1
                n += bool(len(at))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    df, n = np.zeros(BUCKETS), 0
    for bucket, count in rows.groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    return df, n


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray    # languages x (buckets and a constant)
    temperature: float = 1.0

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, n = grams(text)
        x = (1 + np.log(n)) * self.idf[at] if len(at) else n
        size = np.sqrt((x * x).sum())
        return np.append(at, BUCKETS), np.append(x / size if size else x, 1.0)

    def logits(self, text: str | None) -> np.ndarray:
        at, x = self.features(text)
        return self.weights[:, at] @ x

    def predict(self, text: str | None) -> tuple[str, float]:
        if not len(letters(text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_regularised_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n: int) -> np.ndarray:
    """FTRL-proximal for the multinomial loss with elastic net: a weight is
    -(z - sign(z) L1) / ((SMOOTH + sqrt(g)) / RATE + L2) where |z| > L1, else zero; z
    holds the adjusted gradient sums and g the sums of squares."""
    z, g = np.zeros((n, BUCKETS + 1)), np.zeros((n, BUCKETS + 1))

    def weights(at) -> np.ndarray:
        s = z[:, at]
        return -np.sign(s) * np.maximum(np.abs(s) - L1, 0) / ((SMOOTH + np.sqrt(g[:, at])) / RATE + L2)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            w = weights(at)
            error = softmax(w @ x)
            error[y] -= 1
            grad = error[:, None] * x
            old = g[:, at]
            z[:, at] += grad - (np.sqrt(old + grad * grad) - np.sqrt(old)) / RATE * w
            g[:, at] = old + grad * grad
    return weights(slice(None))


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fitted on ``docs`` (leave held-out rows out first); rows without language or
    letters teach nothing.

    Document frequencies cover all rows. About ``per_language`` rows of each language,
    chosen by a hash of the id, train SHARDS learners in tasks of their own, whose
    weights are averaged; as many others set the temperature that gives the least
    log loss. Without a labelled row the model knows no language.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    known = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = known.groupBy("lang").count().orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    model = LanguageModel(languages, idf, np.zeros((len(languages), BUCKETS + 1)))
    if not languages:
        return model
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) / 1_000_000.0
    share = F.create_map(*(F.lit(v) for r in sizes for v in (r["lang"], min(1.0, 2.0 * per_language / r["count"]))))
    chosen = materialize(known.filter(part < F.try_element_at(share, F.col("lang"))).withColumn(
        "shard", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2 * SHARDS)).cast("int")))
    shared = spark.sparkContext.broadcast(model)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        own = shared.value
        number = {l: i for i, l in enumerate(own.languages)}
        group = group.sort_values("id", kind="stable")
        rows = [(*own.features(t), number[l]) for t, l in zip(group.text, group.lang)]
        order = np.random.default_rng(1).permutation(len(rows))
        w = follow_regularised_leader([rows[i] for i in order if len(rows[i][0]) > 1], len(number))
        k, at = np.nonzero(w)
        return pd.DataFrame({"k": k, "bucket": at, "w": w[k, at]})

    learners = chosen.filter(F.col("shard") < SHARDS)
    total = learners.groupBy("shard").applyInPandas(train, "k int, bucket int, w double")
    made = max(1, learners.select("shard").distinct().count())
    for k, bucket, w in total.groupBy("k", "bucket").agg(F.sum("w")).collect():
        model.weights[k, bucket] = w / made
    ready = spark.sparkContext.broadcast(model)

    def losses(batch: pa.RecordBatch):
        own = ready.value
        number = {l: i for i, l in enumerate(own.languages)}
        rows = [(own.logits(t), number[l]) for t, l in zip(column(batch, "text"), column(batch, "lang"))
                if len(letters(t))]
        yield {"k": list(range(len(TEMPERATURES))), "loss": [
            float(-sum(np.log(max(1e-12, softmax(z / t)[y])) for z, y in rows)) for t in TEMPERATURES]}

    held = map_rows(chosen.filter(F.col("shard") >= SHARDS).select("text", "lang"), losses, "k int, loss double")
    found = sorted((loss, k) for k, loss in held.groupBy("k").agg(F.sum("loss")).collect())
    if found:
        model.temperature = TEMPERATURES[found[0][1]]
    return model


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` of every whole text; ``und`` with score 0 for null,
    empty and letterless texts, or if the model knows no language. Repeated rows stay
    repeated, an empty table gives an empty one; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        own = shared.value
        found = [own.predict(t) if own.languages else (UNKNOWN, 0.0) for t in column(batch, "text")]
        yield {"id": array(batch, "id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)
