"""Time slices for servers that hold too many rows for one task.

Nearly all servers are small and are handled whole, as slice 0. A server with
more than ``rows_per_slice`` rows is cut along time into slices of about that
many rows, and every per-server operator then works per (server, slice) with a
small carry between slices. Slices change the layout only, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

ROWS_PER_SLICE = 20_000
MAX_SLICES = 50_000  # largest slice table that is broadcast, about 3 MB
CELL_MICROS = 1_000_000  # resolution of the cuts, that of the time stamps
DAY_MICROS = 86_400 * 1_000_000


def _cell(at_us: Column, width: int) -> Column:
    return F.floor(at_us / F.lit(width)).cast("bigint")


@dataclass(frozen=True)
class SlicePlan:
    """``lookup`` lists, for each hot server and day, the slices of that day.
    ``most_faults`` bounds the rows of the first table in any unit, as far as known."""

    lookup: DataFrame | None = None
    small_lookup: bool = True
    most_faults: int | None = field(default=None, compare=False)

    @property
    def has_hot_servers(self) -> bool:
        return self.lookup is not None

    @property
    def keys(self) -> list[str]:
        """The columns that make one unit of work."""
        return ["sn", "slice"] if self.has_hot_servers else ["sn"]

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``slice`` and ``n_slices`` to rows with ``sn`` and ``at_us``."""
        if self.lookup is None:
            return df.withColumns({"slice": F.lit(0), "n_slices": F.lit(1)})
        lookup = F.broadcast(self.lookup) if self.small_lookup else self.lookup
        look, rows = lookup.alias("look"), df.alias("rows")
        hit = (
            (F.col("rows.sn") == F.col("look.sn"))
            & (_cell(F.col("rows.at_us"), DAY_MICROS) == F.col("look.day"))
            & (F.col("rows.at_us") >= F.col("look.start_us"))
            & (F.col("rows.at_us") < F.col("look.end_us"))
        )
        return rows.join(look, hit, "left").select(
            "rows.*",
            F.coalesce("look.slice", F.lit(0)).alias("slice"),
            F.coalesce("look.n_slices", F.lit(1)).alias("n_slices"),
        )


WHOLE = SlicePlan()


def plan_slices(
    tables: Sequence[DataFrame],
    rows_per_slice: int = ROWS_PER_SLICE,
    cell_us: int = CELL_MICROS,
    max_slices: int = MAX_SLICES,
) -> SlicePlan:
    """Find the hot servers of ``tables`` (each with ``sn``, ``at_us``) and cut them.

    The usual case costs one map-side-combined count over the ``sn`` column. The
    slice size never depends on the data; a table of more than ``max_slices`` slices
    is joined by shuffle instead of broadcast.
    """
    points = reduce(DataFrame.unionByName, [
        t.select("sn", "at_us", F.lit(int(i == 0)).alias("first")) for i, t in enumerate(tables)])
    counts = points.groupBy("sn").agg(F.count("*").alias("n"), F.sum("first").alias("n_first"))
    largest, most_faults = counts.agg(F.max("n"), F.max("n_first")).first()
    if (largest or 0) <= rows_per_slice:
        return SlicePlan(most_faults=most_faults or 0)
    hot = counts.filter(F.col("n") > rows_per_slice).select("sn")

    # rows per cell of the hot servers -> running count -> slice of each cell
    cells = (
        points.join(hot, "sn", "left_semi")
        .groupBy("sn", _cell(F.col("at_us"), cell_us).alias("cell"))
        .agg(F.count("*").alias("n"))
    )
    in_order = Window.partitionBy("sn").orderBy("cell")
    before = F.sum("n").over(in_order) - F.col("n")
    starts = (
        cells.withColumn("cut", F.floor(before / F.lit(rows_per_slice)))
        .groupBy("sn", "cut")
        .agg(F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))
    )
    by_cut = Window.partitionBy("sn").orderBy("cut")
    whole = Window.partitionBy("sn")
    bounds = starts.select(
        "sn",
        (F.row_number().over(by_cut) - 1).alias("slice"),
        (F.col("first_cell") * cell_us).alias("start_us"),
        (
            F.coalesce(F.lead("first_cell").over(by_cut), F.col("last_cell") + 1) * cell_us
        ).alias("end_us"),
        F.count("*").over(whole).cast("int").alias("n_slices"),
    )
    lookup = bounds.withColumn(
        "day",
        F.explode(
            F.sequence(
                _cell(F.col("start_us"), DAY_MICROS), _cell(F.col("end_us") - 1, DAY_MICROS)
            )
        ),
    ).select("sn", "day", "slice", "start_us", "end_us", "n_slices")

    lookup = materialize(lookup)
    return SlicePlan(lookup, lookup.count() <= max_slices, most_faults)
