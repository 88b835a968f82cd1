"""Embedding near-duplicates: inverted multi-index with multi-sequence traversal."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SEED, array, map_rows
from .graph import components

THRESHOLD, TARGET_RECALL = 0.95, 0.995
SAMPLE = 4096        # rows that the traversal depth is measured on, at most
CODE_ROWS = 50       # rows a codeword is trained on, at least, as far as the table has them
FIT_TASKS = 8        # tasks of the k-means sample
PER_CELL = 64        # rows of a cell on average, as far as MAX_CODES allows
MAX_CODES = 1024     # codewords of a half
BASE_CHUNK, PROBE_CHUNK = 256, 512


@dataclass
class MultiIndex:
    """Two codebooks, and how many cells a vector visits."""

    books: tuple[np.ndarray, np.ndarray]
    depth: int

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        half = self.books[0].shape[1]
        return [((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1))
                for part, book in zip((x[:, :half], x[:, half:]), self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The ``depth`` nearest cells of each row, nearest first (the first is its own).

        Of the sorted codewords of both halves, the pair (a, b) is among the first n
        only if (a + 1)(b + 1) <= n, so few pairs are compared.
        """
        da, db = self._distances(x)
        na, nb = da.shape[1], db.shape[1]
        depth = min(self.depth, na * nb)
        oa, ob = np.argsort(da, axis=1, kind="stable"), np.argsort(db, axis=1, kind="stable")
        pairs = np.array([(a, b) for a in range(min(na, depth)) for b in range(min(nb, depth // (a + 1)))])
        if len(pairs) < depth:  # one codebook is short
            pairs = np.array([(a, b) for a in range(na) for b in range(nb)])
        rows = np.arange(len(x))[:, None]
        a, b = oa[:, pairs[:, 0]], ob[:, pairs[:, 1]]
        first = np.argsort(da[rows, a] + db[rows, b], axis=1, kind="stable")[:, :depth]
        return (a[rows, first] * nb + b[rows, first]).astype(np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Place of the cell of ``y`` in the traversal of ``x``, from 1."""
        (da, db), (ya, yb) = self._distances(x), self._distances(y)
        out = np.empty(len(x), dtype=np.int64)
        for i in range(len(x)):
            limit = da[i, ya[i].argmin()] + db[i, yb[i].argmin()]
            out[i] = np.searchsorted(np.sort(db[i]), limit - da[i] - 1e-12).sum() + 1
        return out


def _unit(vector) -> bytes | None:
    if vector is None or len(vector) == 0 or None in vector:
        return None
    x = np.array(vector, dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top  # no overflow in the squares
    return (x / math.sqrt(float(x @ x))).tobytes()


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, unit)``: eight bytes a component; null for what has no direction."""

    def run(batch: pa.RecordBatch):
        yield {"id": array(batch, "id"), "unit": [_unit(v) for v in array(batch, "v").to_pylist()]}

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return map_rows(rows, run, "id bigint, unit binary")


def _matrix(units) -> np.ndarray:
    data = b"".join(units)
    return np.frombuffer(data, dtype=np.float64).reshape(len(units), -1)


def _drawn(distinct: DataFrame, n: int, bound: int) -> DataFrame:
    """The ``bound`` rows of the smallest hash, ``order``: the hash goes by the vector, so
    the draw is the same however the rows lie."""
    rows = distinct.select("unit", F.xxhash64(F.col("unit"), F.lit(SEED)).alias("order"))
    if 1.2 * bound < n:  # all but a few more are left out before they are sorted
        rows = rows.filter(F.col("order") < int(1.2 * bound / n * 2 ** 64) - 2 ** 63)
    return materialize(rows.orderBy("order", "unit").limit(bound))


def fit_index(distinct: DataFrame, n: int, threshold: float, target_recall: float, sample: int) -> MultiIndex:
    """Codebooks by k-means, one for each half, on ``sample`` rows or CODE_ROWS a codeword,
    whichever is more. The depth is the smallest at which that share of made-up worst
    partners (random directions at exactly the threshold) would be met from either side,
    raised by two standard errors. It is measured on at most ``sample`` other rows: those
    of the training lie unusually near their codewords."""
    codes = max(1, min(MAX_CODES, math.ceil(math.sqrt(n / PER_CELL))))
    unseen = min(sample, n // 4)
    drawn = _drawn(distinct, n, unseen + max(sample, CODE_ROWS * codes))
    rows = drawn.orderBy("order", "unit").limit(max(unseen, 1)).collect()
    x = _matrix([bytes(r["unit"]) for r in rows])
    if unseen:  # else a table of three rows at most
        drawn = drawn.filter(F.col("order") > rows[-1]["order"])
    half = (x.shape[1] + 1) // 2

    def halves(batch: pa.RecordBatch):
        part = _matrix(array(batch, "unit").to_pylist()) if batch.num_rows else np.zeros((0, x.shape[1]))
        yield {"a": list(part[:, :half]), "b": list(part[:, half:])}

    points = materialize(map_rows(drawn.repartition(FIT_TASKS), halves, "a array<double>, b array<double>"))
    books = []
    for name, width in (("a", half), ("b", x.shape[1] - half)):
        if width == 0:
            books.append(np.zeros((1, 0)))
            continue
        features = points.select(array_to_vector(name).alias("features"))
        if codes == 1:  # k-means wants two; of one codeword it is the mean
            books.append(np.array([features.select(Summarizer.mean(F.col("features"))).first()[0]]))
            continue
        books.append(np.array(KMeans(k=codes, seed=1, maxIter=10).fit(materialize(features)).clusterCenters()))
    index = MultiIndex(tuple(books), 1)
    rng = np.random.default_rng(1)
    x = np.resize(x, (max(sample, len(x)), x.shape[1]))  # a small table's rows get several partners each
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(1 - threshold ** 2) * side
    met = np.sort(np.minimum(index.rank(x, y), index.rank(y, x)))
    share = target_recall + 2 * math.sqrt(target_recall * (1 - target_recall) / len(met))
    index.depth = int(met[min(len(met), math.ceil(share * len(met))) - 1])
    return index


ROWS = "cell bigint, base boolean, key bigint, n bigint, own bigint, unit binary, visits array<bigint>"


def _placed(distinct: DataFrame, index: MultiIndex) -> DataFrame:
    """Each vector once as base in its own cell, and as probe in each cell it visits."""
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        units, key, n = array(batch, "unit"), array(batch, "key"), array(batch, "n")
        cells = shared.value.cells(_matrix(units.to_pylist()))
        own, depth = cells[:, 0], cells.shape[1]
        yield {"cell": own, "base": [True] * len(own), "key": key, "n": n, "own": own, "unit": units,
               "visits": list(cells)}
        for k in range(depth):
            yield {"cell": cells[:, k], "base": [False] * len(own), "key": key, "n": n, "own": own, "unit": units,
                   "visits": [None] * len(own)}

    return map_rows(distinct.select("key", "n", "unit"), run, ROWS)


def _dealt(placed: DataFrame) -> DataFrame:
    """Cells in blocks of about BASE_CHUNK x PROBE_CHUNK rows, so that a crowded cell is
    many small tasks: a base row goes to every probe chunk of its cell, a probe to every
    base chunk."""
    sizes = placed.groupBy("cell").agg(
        F.sum(F.col("base").cast("bigint")).alias("bases"), F.sum((~F.col("base")).cast("bigint")).alias("probes"))
    chunks = sizes.filter("bases > 0").select(
        "cell", F.ceil(F.col("bases") / BASE_CHUNK).cast("int").alias("nb"),
        F.ceil(F.col("probes") / PROBE_CHUNK).cast("int").alias("np"))
    rows = placed.join(materialize(chunks), "cell")
    spread = F.pmod(F.xxhash64("key"), F.when(F.col("base"), F.col("nb")).otherwise(F.col("np"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("base"), F.col("np")).otherwise(F.col("nb")) - 1))
    rows = rows.withColumn("mine", spread).withColumn("other", other)
    return rows.withColumns({
        "b": F.when(F.col("base"), F.col("mine")).otherwise(F.col("other")),
        "p": F.when(F.col("base"), F.col("other")).otherwise(F.col("mine")),
    }).drop("mine", "other", "nb", "np")


def _verify(threshold: float):
    """Exact cosines of a block: links of each vector, and spanning edges.

    A pair that both ends could find is counted by one of them only: in one cell by the
    smaller key as probe, else in the larger of the two cells.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        base, probe = group[group.base], group[~group.base]
        if base.empty or probe.empty:
            return pd.DataFrame({"u": [], "v": [], "links": []})
        cell = int(base.cell.iloc[0])
        bk, pk, own = base.key.to_numpy(), probe.key.to_numpy(), probe.own.to_numpy()
        near = _matrix(list(probe.unit)) @ _matrix(list(base.unit)).T >= threshold
        near &= ~((own == cell)[:, None] & (pk[:, None] >= bk[None, :]))
        later = np.unique(own[(own > cell) & near.any(axis=1)])  # cells where the base would find the probe
        for other in later:
            finds = np.array([other in visits for visits in base.visits])
            near[np.ix_(own == other, finds)] = False
        i, j = np.nonzero(near)
        if not len(i):
            return pd.DataFrame({"u": [], "v": [], "links": []})
        bn, pn = base.n.to_numpy(), probe.n.to_numpy()
        row, col = near @ bn, pn @ near
        u = [pk[row > 0], bk[col > 0]]
        links = [row[row > 0], col[col > 0]]
        # spanning edges: each probe to its first partner, and partners of a common probe
        # to one another through labels
        keys = np.concatenate([pk, bk])
        root = _bipartite(near)
        moved = np.flatnonzero(root != np.arange(len(root)))
        out = [pd.DataFrame({"u": np.concatenate(u), "v": pd.NA, "links": np.concatenate(links)}),
               pd.DataFrame({"u": keys[moved], "v": keys[root[moved]], "links": 0})]
        return pd.concat(out).astype({"u": "int64", "v": "Int64", "links": "int64"})

    return run


def _bipartite(near: np.ndarray) -> np.ndarray:
    """Smallest connected row of probes followed by bases."""
    m, k = near.shape
    label = np.arange(m + k)
    while True:
        p, b = label[:m], label[m:]
        p2 = np.minimum(p, np.where(near, b[None, :], m + k).min(axis=1))
        b2 = np.minimum(b, np.where(near, p2[:, None], m + k).min(axis=0))
        lower = np.concatenate([p2, b2])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL,
                    sample: int = SAMPLE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row.

    Rows link if their cosine, in double precision, is at least ``threshold``. Codebooks
    on both vector halves form a product grid; every vector visits its nearest cells in
    multi-sequence order, as many as ``target_recall`` needs on a bounded sample that the
    codebooks have not seen, and what it meets is verified exactly. A pair missed from both sides is missed.

    Null or zero vectors and null or non-finite components link with nothing and stand for
    themselves. Vectors of different lengths do not link; each length has an index of its
    own, one after the other. Equal directions are one vector with a weight, so that copies
    cost one row. A null id is ignored for the smallest id of a component and never kept.
    An empty table gives an empty one; other columns are not read.
    """
    rows = materialize(unit_vectors(vectors, id_col, vec_col))
    lengths = [r["size"] for r in rows.filter("unit is not null").select(
        F.length("unit").alias("size")).distinct().orderBy("size").collect()]
    named = [_link_one(rows.filter(F.length("unit") == n), threshold, target_recall, sample) for n in lengths]
    if not named:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
                           F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    whole = named[0]
    for part in named[1:]:
        whole = whole.unionByName(part)
    out = rows.join(whole, "unit", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _link_one(usable: DataFrame, threshold: float, target_recall: float, sample: int) -> DataFrame:
    """``(unit, component_id, n_links)`` of the distinct vectors of one length."""
    distinct = materialize(usable.groupBy("unit").agg(F.min("id").alias("first"), F.count("*").alias("n"))
                           .withColumn("key", F.monotonically_increasing_id()))
    index = fit_index(distinct, distinct.count(), threshold, target_recall, sample)
    found = _dealt(_placed(distinct, index)).groupBy("cell", "b", "p").applyInPandas(
        _verify(threshold), "u bigint, v bigint, links bigint")
    found = materialize(found)
    links = found.filter("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("v is not null"))
    named = distinct.join(parts, distinct.key == parts.node, "left").select(
        "key", "unit", "first", "n", F.coalesce("rep", "key").alias("rep"))
    lowest = named.groupBy("rep").agg(F.min("first").alias("component_id"))
    return named.join(lowest, "rep").join(links, "key", "left").select(
        "unit", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
