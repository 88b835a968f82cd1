"""Fold assignment, hold-out split and class weights.

Folds are a stored column: they depend on the row key and the seed only, never
on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import split_row_number

# Fixed values.
FOLDS = 5
FOLD_SEED = 2010
PLAIN_FOLD_SEED = 2016
HOLDOUT_SEED = 2022
HOLDOUT_SHARE = 0.25

BUCKET_DIGITS = 3  # hex digits of the bucket a row is numbered in: 16 times as many buckets for each


def _shuffled_rank(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], seed: int,
                   digits: int) -> DataFrame:
    """Random but repeatable position of each row within its group: by the md5 of its
    key and the seed. A bucket is a beginning of the md5; choose ``digits`` so that a
    class divided by 16 to that power still fits a task."""
    spread = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in row_id), F.lit(str(seed))))
    return split_row_number(
        df, keys, F.substring(spread, 1, digits), [spread, *map(F.col, row_id)], "_position"
    )


def stratified_folds(
    df: DataFrame, row_id: Sequence[str] = ("row_id",), label: str = "label", k: int = FOLDS,
    seed: int = FOLD_SEED, digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``fold``: class sizes differ by at most one between folds."""
    ranked = _shuffled_rank(df, [label], row_id, seed, digits)
    return ranked.withColumn("fold", ((F.col("_position") - 1) % k).cast("int")).drop("_position")


def plain_folds(
    df: DataFrame, row_id: Sequence[str] = ("row_id",), k: int = FOLDS,
    seed: int = PLAIN_FOLD_SEED, digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``fold``, shuffled without regard to classes; sizes differ by at most one."""
    ranked = _shuffled_rank(df, [], row_id, seed, digits)
    return ranked.withColumn("fold", ((F.col("_position") - 1) % k).cast("int")).drop("_position")


def stratified_holdout(
    df: DataFrame, row_id: Sequence[str] = ("row_id",), label: str = "label",
    share: float = HOLDOUT_SHARE, seed: int = HOLDOUT_SEED, digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``is_validation`` for exactly the rounded share of every class."""
    ranked = _shuffled_rank(df, [label], row_id, seed, digits)
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))  # one row per class
    return (
        ranked.join(F.broadcast(sizes), label)
        .withColumn("is_validation", F.col("_position") <= F.rint(F.col("_size") * share))
        .drop("_position", "_size")
    )


def training_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") != fold)


def validation_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") == fold)


def distinct_classes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).distinct()


def balanced_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``rows / (classes * rows of the class)`` for every class present."""
    counted = df.groupBy(label).agg(F.count("*").alias("cnt"))
    whole = counted.agg(F.sum("cnt").alias("rows"), F.count("*").alias("classes"))
    ratio = whole.select((F.col("rows") / F.col("classes")).alias("r")).scalar()
    return counted.select(label, "cnt", (ratio / F.col("cnt")).alias("weight"))


def map_class_weight(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Attach each row's class weight; the weight table has one row per class."""
    return df.join(F.broadcast(weights.select(label, "weight")), label, "left")
