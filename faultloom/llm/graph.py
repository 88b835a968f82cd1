"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

EDGE = "u bigint, v bigint"


class Forest:
    """Union-find over integers; roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """An edge from each member that is no root to its root."""
        pairs = [(x, r) for x in self.parent if (r := self.find(x)) != x]
        flat = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return flat[:, 0], flat[:, 1]


def spread_labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row it is connected to."""
    label = np.arange(len(near))
    while True:
        lower = np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near))
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the edges of each batch: never more rows than came in."""
    for batch in batches:
        forest = Forest()
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest.stars()], names=["u", "v"])


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, rep)`` for every node of ``edges (u, v)``: equal ``rep`` means connected.

    Repeated contraction: every node moves to the neighbour (or itself) with the
    smallest hash of the round, edges are rewritten and made distinct. The expected
    number of nodes falls by a constant factor a round, also along chains, and only
    joins and partially combined aggregates are used, so that a hub is no single task.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    edges = edges.select("u", "v").filter("u is not null and v is not null and u <> v")
    rest = materialize(_distinct(edges.mapInArrow(_forest, EDGE)))
    moves: list[DataFrame] = []
    while not rest.isEmpty():
        seed = F.lit(len(moves) + 1)
        both = rest.union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialize(
            both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", seed).alias("h"), "v")).alias("near"))
            .select("u", F.when(F.xxhash64("u", seed) < F.col("near.h"), F.col("u"))
                    .otherwise(F.col("near.v")).alias("to"))
        )
        moves.append(step)
        left = step.select("u", F.col("to").alias("a"))
        right = step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = rest.join(left, "u").join(right, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        rest = materialize(_distinct(moved.mapInArrow(_forest, EDGE)))
    if not moves:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("rep"))
    found = moves[0].select(F.col("u").alias("node"), F.col("to").alias("rep"))
    for step in moves[1:]:
        later = step.select(F.col("u").alias("rep"), "to")
        found = found.join(later, "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
    return materialize(found)
