"""Positions of rows in a total order, however large a group is, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order`` within ``group``, nulls first) and
    ``size`` (rows of the group), both written out.

    One sort over ranges of (group, order) spreads a group over as many tasks as its rows
    need; a row's place in its task, less where its group began there, plus what the
    group has in earlier tasks, is its rank. Only the run lengths, one row a group and
    task, are windowed. Rows equal in ``group`` and ``order`` get consecutive ranks in any
    order; a third of all rows with one null key still needs distinct ``order`` values to
    be spread. Nulls are groups like others; an empty table gives an empty one. The names
    ``rank``, ``size`` and those beginning with ``_at`` must be free.
    """
    group = list(group)
    rows = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*group, *order)])
    rows = rows.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*group, *order)])
    # the id holds the task in its upper bits and the place in the task in its lower 33
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id())
                       .withColumn("_at_task", F.shiftright("_at", 33)))
    runs = rows.groupBy(*group, "_at_task").agg(F.min("_at").alias("_at_first"), F.count("*").alias("_at_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_at_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "_at_task", "_at_first", F.sum("_at_n").over(whole).alias("size"),
                       F.coalesce(F.sum("_at_n").over(earlier), F.lit(0)).alias("_at_before"))
    same = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*group, "_at_task")])
    placed = rows.alias("r").join(runs.alias("o"), same)
    return materialize(placed.select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("r._at") - F.col("o._at_first") + F.col("o._at_before")).alias("rank"), F.col("o.size")))


def join_small(rows: DataFrame, small: DataFrame, on: Sequence[str], n_small: int,
               bound: int = 100_000, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of ``n_small`` rows that is unique on ``on``.

    Up to ``bound`` rows it is broadcast. Beyond, both are shuffled, and each key is dealt
    out over 64 parts by the hash of the row, with a copy of ``small`` for each, so that a
    key that holds a third of ``rows`` is no single task.
    """
    if n_small <= bound:
        return rows.join(F.broadcast(small), list(on), how)
    salts = 64
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
