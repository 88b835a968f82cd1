"""Row numbers over large groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_row_number(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """1-based row number per ``keys`` in the order (bucket, order).

    A plain window would put a whole group in one task. Here each (group,
    bucket) is numbered on its own and shifted by the size of the earlier
    buckets, which are counted with map-side combine. ``bucket`` must agree
    with the wanted order and keep its groups small.
    """
    rows = df.withColumn("_bucket", bucket)
    # the grouping may be empty: one constant group then
    group = list(keys) or [F.lit(0)]
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_rank", F.row_number().over(within)).alias("r")
    same = reduce(
        and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*keys, "_bucket"]]
    )
    position = (F.col("o._before") + F.col("r._rank")).alias(name)
    return numbered.join(offsets.alias("o"), same).select(
        *[f"r.`{c}`" for c in df.columns], position
    )
