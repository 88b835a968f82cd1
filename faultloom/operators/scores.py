"""Metrics and ensembling over scored tables.

A scored table has a row key, ``target`` and either a predicted class or
probability arrays. Every metric is one map-side-combined aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.columns import NUM_CLASSES
from .ranking import split_row_number

# Weight of each class in the score, and the loss parameters.
CLASS_WEIGHTS = (5 / 11, 4 / 11, 1 / 11, 1 / 11)
ALTERNATIVE_CLASS_WEIGHTS = (3 / 7, 2 / 7, 1 / 7, 1 / 7)
FOCAL_ALPHA = 0.75
FOCAL_GAMMA = 2.0
EMA_DECAY = 0.9


def confusion_cells(
    scored: DataFrame, target: str = "target", predicted: str = "predict",
    by: Sequence[str] = (),
) -> DataFrame:
    """Row count per (target, predicted) pair."""
    return scored.groupBy(
        *by, F.col(target).cast("int").alias("target"), F.col(predicted).cast("int").alias("predict")
    ).agg(F.count("*").alias("n"))


def confusion_counts(
    scored: DataFrame, target: str = "target", predicted: str = "predict",
    by: Sequence[str] = (), classes: int = NUM_CLASSES,
) -> DataFrame:
    """True positives, false positives and false negatives per class; a class
    that neither occurs nor is predicted has zeros."""
    return _class_counts(confusion_cells(scored, target, predicted, by), by, classes)


def _class_counts(cells: DataFrame, by: Sequence[str], classes: int) -> DataFrame:
    t, p = F.col("target"), F.col("predict")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counts = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                total((t == c) & (p == c)).alias("tp"),
                total(~t.eqNullSafe(F.lit(c)) & (p == c)).alias("fp"),
                total((t == c) & ~p.eqNullSafe(F.lit(c))).alias("fn"),
            )
            for c in range(classes)
        ]
    )
    return cells.groupBy(*by).agg(counts.alias("c")).select(*by, F.inline("c"))


def _f1() -> Column:
    """F1 from counts; 0 where a ratio has no denominator."""
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def weighted_macro_f1(
    scored: DataFrame, target: str = "target", predicted: str = "predict",
    by: Sequence[str] = (), weights: Sequence[float] = CLASS_WEIGHTS,
) -> DataFrame:
    """Weighted sum of the class F1 values, in total or per group.

    Rows outside the known classes count as errors only.
    """
    counts = confusion_counts(scored, target, predicted, by, len(weights))
    return _weighted_score(counts, by, weights)


def _weighted_score(counts: DataFrame, by: Sequence[str], weights: Sequence[float]) -> DataFrame:
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1)
    return counts.groupBy(*by).agg(F.sum(weight * _f1()).alias("macro_f1"))


def prediction_counts(scored: DataFrame, predicted: str = "predict") -> DataFrame:
    return scored.groupBy(predicted).agg(F.count("*").alias("cnt"))


def fold_scores(
    scored: DataFrame, probs: Mapping[str, str], target: str = "target", fold: str = "fold",
    weights: Sequence[float] = CLASS_WEIGHTS,
) -> DataFrame:
    """One score per model and fold, plus the pooled score as fold null.

    ``probs`` maps model names to probability columns.
    """
    models = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("model"), fx.argmax(F.col(col)).alias("predict"))
                for name, col in probs.items()
            ]
        )
    ).alias("m")
    long = scored.select(fold, F.col(target).alias("target"), models).select(
        "m.*", F.col(fold).alias("fold"), "target"
    )
    cells = confusion_cells(long, by=["model", "fold"])
    # pooled and per-fold scores from the same few cells
    both = cells.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))))
    by = ["model", "fold"]
    return _weighted_score(_class_counts(both, by, len(weights)), by, weights)


def fold_score_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores and the pooled score."""
    per_fold = F.when(F.col("fold").isNotNull(), F.col("macro_f1"))
    return scores.groupBy("model").agg(
        F.count("fold").alias("folds"),
        F.avg(per_fold).alias("mean_score"),
        F.stddev_pop(per_fold).alias("std_score"),
        F.max(F.when(F.col("fold").isNull(), F.col("macro_f1"))).alias("oof_score"),
    )


def fold_average(
    long: DataFrame, keys: Sequence[str] = ("row_id",), prob: str = "prob", how: str = "mean",
    classes: int = NUM_CLASSES,
) -> DataFrame:
    """Element-wise mean or sum of several probability arrays per row."""
    combine = {"mean": F.avg, "sum": F.sum}[how]
    return long.groupBy(*keys).agg(
        F.array(*[combine(F.col(prob)[c]) for c in range(classes)]).alias(prob)
    )


# --- losses ----------------------------------------------------------------------------

def _log_hit(z: Column) -> Column:
    """log of the logistic function, finite for every finite ``z``."""
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def _focal_parts(x: Column, t: Column, alpha: float) -> tuple[Column, Column, Column, Column, Column]:
    """Sign of the target, class weight, probability of the target, that of the other
    outcome, and logs of both, all from the margin ``z = sign * x``."""
    sign = 2 * t - 1
    log_p, log_q = _log_hit(sign * x), _log_hit(-sign * x)
    return sign, alpha * t + (1 - alpha) * (1 - t), F.exp(log_p), log_p, log_q


def _focal_cell(x: Column, t: Column, alpha: float, gamma: float) -> Column:
    """Focal loss of one logit ``x`` with 0/1 target ``t``: the weighted cross-entropy
    times the gamma-th power of the probability missed."""
    _, weight, _, log_p, log_q = _focal_parts(x, t, alpha)
    return -weight * F.exp(gamma * log_q) * log_p


def _cells(scored: DataFrame, logits: str, target: str, keys: Sequence[str], classes: int):
    """One row per (row, class) with logit ``x`` and target indicator ``t``."""
    exploded = scored.select(
        *keys, F.col(target).alias("_target"), F.posexplode(logits).alias("class", "x")
    ).filter(F.col("class") < classes)
    return exploded.withColumns(
        {"x": F.col("x").cast("double"), "t": (F.col("_target") == F.col("class")).cast("double")}
    ).drop("_target")


def focal_loss(
    scored: DataFrame, logits: str = "logits", target: str = "target",
    alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA, classes: int = NUM_CLASSES,
) -> DataFrame:
    """Mean focal loss over all (row, class) cells."""
    cells = _cells(scored, logits, target, (), classes)
    return cells.agg(
        F.avg(_focal_cell(F.col("x"), F.col("t"), alpha, gamma)).alias("focal_loss")
    )


def focal_gradient(
    scored: DataFrame, logits: str = "logits", target: str = "target",
    keys: Sequence[str] = ("row_id",), alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA,
    classes: int = NUM_CLASSES,
) -> DataFrame:
    """First and second derivative of the focal loss by its logit, in closed form.
    Long form: one row per (row, class)."""
    cells = _cells(scored, logits, target, keys, classes)
    sign, weight, p, log_p, log_q = _focal_parts(F.col("x"), F.col("t"), alpha)
    q, scale = F.exp(log_q), weight * F.exp(gamma * log_q)
    return cells.select(
        *keys, "class",
        (sign * scale * (gamma * p * log_p - q)).alias("grad"),
        (scale * p * ((2 * gamma + 1) * q + gamma * q * log_p - gamma * gamma * p * log_p)).alias("hess"),
    )


def softmax_log_loss(
    scored: DataFrame, logits: str = "logits", target: str = "target"
) -> DataFrame:
    """Mean softmax cross-entropy: log of the summed exponentials less the own logit."""
    rows = scored.select(
        F.transform(logits, lambda x: x.cast("double")).alias("x"), F.col(target).alias("t")
    ).withColumn("top", F.array_max("x"))
    total = F.aggregate(F.col("x"), F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    own = F.element_at("x", (F.col("t") + 1).cast("int"))
    return rows.agg(F.avg(F.col("top") + F.log(total) - own).alias("log_loss"))


# --- pseudo labels ----------------------------------------------------------------------

# Classes accepted as pseudo labels and their least probability.
PSEUDO_CLASSES = (0, 1)
PSEUDO_THRESHOLD = 0.8


def confident_rows(
    scored: DataFrame, prob: str = "prob", classes: Sequence[int] = PSEUDO_CLASSES,
    threshold: float = PSEUDO_THRESHOLD,
) -> DataFrame:
    """Rows whose likeliest class is an accepted one, and likely enough; the
    class becomes ``label``."""
    label = fx.argmax(F.col(prob))
    accepted = label.isin(list(classes)) & (F.array_max(prob) >= threshold)
    return scored.filter(accepted).withColumn("label", label)


def append_pseudo(labelled: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Labelled and pseudo-labelled rows in one table, ``is_real`` telling them apart."""
    return labelled.withColumn("is_real", F.lit(1)).unionByName(
        pseudo.withColumn("is_real", F.lit(0)), allowMissingColumns=True
    )


def without_pseudo(rows: DataFrame, pseudo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are not among the pseudo-labelled ones."""
    return rows.join(pseudo.select(*keys), list(keys), "left_anti")


# --- smoothing ------------------------------------------------------------------------

def with_steps(
    df: DataFrame, keys: Sequence[str], order: str, width: int = 1_000_000
) -> DataFrame:
    """Number the rows of each series 1, 2, .. along an integer column."""
    return split_row_number(
        df, keys, F.floor(F.col(order) / F.lit(width)), [F.col(order)], "step"
    )


def final_ema(
    series: DataFrame, keys: Sequence[str], value: str = "value", step: str = "step",
    decay: float = EMA_DECAY,
) -> DataFrame:
    """Exponential moving average (from 0) after the last step of each series.

    Steps are 1, 2, .. without gaps. The average is the sum of the values
    weighted by ``(1 - decay) * decay ** (last - step)``; as a sum it combines
    on the map side, so a long series needs no single task.
    """
    last = series.groupBy(*keys).agg(F.max(step).alias("_last"))
    age = F.col("_last") - F.col(step)
    weight = (1 - decay) * F.pow(F.lit(float(decay)), age.cast("double"))
    return series.join(last, list(keys)).groupBy(*keys).agg(
        F.max("_last").alias("steps"), F.sum(weight * F.col(value)).alias("ema")
    )
