"""Readers for the four CSV inputs and the stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..session import materialize

MAX_SPLITS = 100_000  # largest table of file splits that is broadcast

# Columns every table must have; others in the files are passed through as text.
FAULT_COLUMNS = {"sn": "string", "fault_time": "string", "label": "int"}
LOG_COLUMNS = {"sn": "string", "time": "string", "msg": "string", "server_model": "string"}
CRASHDUMP_COLUMNS = {"sn": "string", "fault_time": "string", "fault_code": "string"}
VENUS_COLUMNS = {
    "sn": "string", "fault_time": "string", "module_cause": "string", "module": "string",
}


def _paths(files) -> list[str]:
    if isinstance(files, str):
        return [files]
    if isinstance(files, list):
        return files
    return []


def read_csv_union(
    spark: SparkSession, files, columns: dict[str, str], multiline: bool = False,
    order: str | None = None,
) -> DataFrame:
    """All files as one table, matched by header name; a column that a file lacks
    is null there. Anything but a path or a list of paths gives an empty table.

    ``multiline`` lets quoted fields hold line breaks; such files are not splittable,
    one task reads each. ``order`` names a column for the position of a row in the
    files: by the place of its path in ``files``, then by file name, then in the file.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    parts = [
        spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)
        for path in _paths(files)
    ]
    if not parts:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(order, F.lit(0).cast("bigint")) if order else empty
    if order:
        parts = [
            part.select("*", F.lit(i).alias("_place"), F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_start"))
            for i, part in enumerate(parts)
        ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.withColumns(
        {
            name: (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)
            for name, kind in columns.items()
        }
    )
    return _in_file_order(rows, order) if order else rows


def _in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Number rows by split, then by their place in it.

    Spark deals splits to tasks by size, so the running number of a task tells the
    order inside a split only. The table of splits has one row for each, whatever the
    number of rows; it is ordered in one task, written, counted, and broadcast up to
    ``MAX_SPLITS`` rows (some 20 MB), so the rows themselves are not shuffled.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    split = ["_place", "_file", "_start"]
    ranks = materialize(rows.select(*split).distinct().withColumn(
        "_rank", F.row_number().over(Window.orderBy(*split)).cast("bigint") - 1))
    joined = rows.join(F.broadcast(ranks) if ranks.count() <= MAX_SPLITS else ranks, split)
    return joined.withColumn(name, F.shiftleft("_rank", 33) + F.col("_row")).drop(*split, "_rank", "_row")


def read_faults(
    spark: SparkSession, files, training: bool = True, tolerant: bool = False
) -> DataFrame:
    """Fault table with parsed time and epoch seconds; label -1 if not training.

    Rows are unordered; order with :func:`sort_faults` where it is shown.
    """
    rows = read_csv_union(spark, files, FAULT_COLUMNS)
    if not training:
        rows = rows.withColumn("label", F.lit(fx.UNLABELLED))
    rows = rows.withColumn("fault_time", fx.parse_timestamp(F.col("fault_time"), tolerant))
    return rows.withColumn("fault_time_ts", fx.epoch_seconds(F.col("fault_time")))


def read_logs(
    spark: SparkSession, files, tolerant: bool = False, multiline: bool = False
) -> DataFrame:
    """Log table with parsed time, epoch seconds and ``ord``, the position in the
    files, which decides between rows of equal time."""
    rows = read_csv_union(spark, files, LOG_COLUMNS, multiline, order="ord")
    rows = rows.withColumn("time", fx.parse_timestamp(F.col("time"), tolerant))
    return rows.withColumn("time_ts", fx.epoch_seconds(F.col("time")))


def read_crashdump(spark: SparkSession, files, tolerant: bool = False) -> DataFrame:
    rows = read_csv_union(spark, files, CRASHDUMP_COLUMNS)
    return rows.withColumn("fault_time", fx.parse_timestamp(F.col("fault_time"), tolerant))


def read_venus(spark: SparkSession, files, tolerant: bool = False) -> DataFrame:
    rows = read_csv_union(spark, files, VENUS_COLUMNS)
    return rows.withColumn("fault_time", fx.parse_timestamp(F.col("fault_time"), tolerant))


def sort_faults(faults: DataFrame) -> DataFrame:
    return faults.orderBy("sn", "fault_time", "label")


def sort_logs(logs: DataFrame) -> DataFrame:
    return logs.orderBy("sn", "time", "ord")


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table for heavy per-row work: if it comes in fewer splits than
    there are cores, its rows are dealt out first. Large tables have more splits
    than cores and are left alone."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_features(
    spark: SparkSession, path: str, features: Sequence[str], label: str = "label",
    keys: Sequence[str] = (),
) -> DataFrame:
    """The model inputs, the label and the keys of a stored feature table."""
    return spark.read.parquet(path).select(*keys, *features, label)
