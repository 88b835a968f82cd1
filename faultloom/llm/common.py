"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# base of the seeds, so that the training sample of one model is not that of another
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def fold_of(id_col: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


BATCH_BYTES = 4_000_000
_BATCH_SETTING, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "1b"


def bound_batches(spark: SparkSession) -> None:
    """Batches of about BATCH_BYTES for Python tasks (a longer row is one by itself),
    unless the session says otherwise: Spark's own bound is one of rows, however long."""
    if spark.conf.get(_BATCH_SETTING, _UNSET) == _UNSET:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``function`` turns a batch into column dicts; one Arrow batch for each."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [_typed(columns[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def array(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sample_ids(rows: DataFrame, id_col: str, bound: int, seed: int = SEED) -> DataFrame:
    """At most ``bound`` rows, those of the smallest hash of their id: the bounded
    training sample of a model, the same at every run."""
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    return rows.orderBy(order, id_col).limit(bound)
