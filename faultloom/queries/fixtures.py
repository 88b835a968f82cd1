"""The given tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..sources import readers

LOGIT_SCALE = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _event_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "user_id",
        F.concat(F.lit("SN"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("sn"),
        second.alias("time"),
        fx.epoch_seconds(second).alias("time_ts"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log message of its user's server."""
    category = (
        F.when(F.col("event_type") == "view", "Memory")
        .when(F.col("event_type") == "click", "System")
        .when(F.col("event_type") == "signup", "Processor")
        .when(F.col("event_type") == "purchase", "Drive")
        .otherwise("Gizmo")
    )
    msg = F.concat(
        category, F.lit(" #0x"), (F.col("k") % 10).cast("string"), F.lit(" | "),
        F.col("event_type"), F.lit(" | Asserted"),
    )
    return _event_columns(spark, sf_dir).select(
        "sn", "time", msg.alias("msg"),
        F.concat(F.lit("SM"), (F.col("user_id") % 12).cast("string")).alias("server_model"),
        "time_ts", F.col("event_id").alias("ord"),
    )


def all_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as labelled faults, duplicates included."""
    k = F.col("k")
    label = F.when(k < 10, 0).when(k < 30, 1).when(k < 60, 2).otherwise(3)
    return _event_columns(spark, sf_dir).filter("event_type = 'error'").select(
        "sn", F.col("time").alias("fault_time"), label.alias("label"),
        F.col("time_ts").alias("fault_time_ts"),
    )


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_faults(spark, sf_dir).dropDuplicates(["sn", "fault_time", "label"])


def submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signup events as faults without a label."""
    return _event_columns(spark, sf_dir).filter("event_type = 'signup'").select(
        "sn", F.col("time").alias("fault_time"), F.lit(fx.UNLABELLED).alias("label"),
        F.col("time_ts").alias("fault_time_ts"),
    ).dropDuplicates(["sn", "fault_time", "label"])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' class probabilities per row, from embedding elements. The
    elements are small, so they are scaled to give confident rows too."""
    emb = table(spark, sf_dir, "embeddings")
    logits = {
        f"logit_{m}": F.transform(
            F.slice("embedding", 1 + 4 * i, 4), lambda x: x.cast("double") * LOGIT_SCALE
        )
        for i, m in enumerate("abc")
    }
    frame = emb.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") % 4).alias("target"),
        (F.col("vec_id") % 5).cast("int").alias("fold"),
        *[c.alias(name) for name, c in logits.items()],
    )
    return frame.withColumns({f"prob_{m}": fx.softmax(F.col(f"logit_{m}")) for m in "abc"})


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a training table: ``row_id, label, embedding``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") % 4).alias("label"), "embedding"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    return readers.read_spread(spark, path).select("doc_id", "text")
