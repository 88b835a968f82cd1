"""Min-max scaling of numeric arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MinMaxModel:
    lows: tuple[float, ...]
    highs: tuple[float, ...]

    def transform(self, values: Column) -> Column:
        """Scaled array; a constant feature becomes 0. Values outside the
        fitted range are not clipped."""
        spans = [h - l if h > l else 1.0 for l, h in zip(self.lows, self.highs)]
        lows = F.array(*[F.lit(float(v)) for v in self.lows])
        widths = F.array(*[F.lit(float(v)) for v in spans])
        moved = F.zip_with(values, lows, lambda x, low: x.cast("double") - low)
        return F.zip_with(moved, widths, lambda x, width: x / width)


def fit_min_max(df: DataFrame, values: str) -> MinMaxModel:
    """Smallest and largest value per position: one tree aggregate."""
    vector = array_to_vector(F.transform(F.col(values), lambda x: x.cast("double")))
    row = df.select(Summarizer.metrics("min", "max").summary(vector).alias("s")).select(
        vector_to_array("s.min").alias("low"), vector_to_array("s.max").alias("high")
    ).first()
    return MinMaxModel(tuple(row["low"]), tuple(row["high"]))


def assemble_array(df: DataFrame, columns: Sequence[str], fill: float = -1.0) -> Column:
    """Numeric columns as one array, nulls replaced."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in columns])
