"""Classifiers: four-class boosted trees, their cross-validation, and an MLP.

A four-class model is one binary boosted model per class, by the loss and the stopping
rule of Spark ML's ``GBTClassifier``, whose probabilities are scaled to sum 1. The models of
all classes and folds grow side by side on one table of bins (``boosting``); the driver
only steers the fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.categories import UNKNOWN_CATEGORY
from ..functions.columns import NUM_CLASSES
from . import boosting as bo
from . import folds as fd
from . import scores as sc
from .scaling import MinMaxModel, fit_min_max

FEATURES = "features"


@dataclass(frozen=True)
class TreeSettings:
    """Settings of one kind of boosted-tree model."""

    name: str
    depth: int
    step: float = 0.1
    rows: float = 1.0
    columns: str = "all"
    min_rows: int = 1
    min_gain: float = 0.0
    rounds: int = 100
    tolerance: float = 0.001
    seed: int = 2022
    bins: int = 64


# Learning rate 0.1 and seed 2022 everywhere; depth, row and column
# share, leaf size and split gain per kind. The column share is drawn once a tree.
TREES_A = TreeSettings("a", depth=6, rows=0.8, columns="0.8", min_rows=20)
TREES_B = TreeSettings("b", depth=5, rows=0.7, columns="0.7", min_gain=0.0)
TREES_C = TreeSettings("c", depth=6, min_rows=20)
ENSEMBLE = (TREES_A, TREES_B, TREES_C)


# --- feature vectors ----------------------------------------------------------------------

def assemble(
    df: DataFrame, columns: Sequence[str] = (), arrays: Sequence[str] = (),
    vectors: Sequence[str] = (), categorical: Mapping[str, int] | None = None,
    fill: float = -1.0,
) -> DataFrame:
    """Add the ``features`` vector. Null numbers become ``fill``, because the
    trees take no missing values.

    ``categorical`` maps integer columns to their number of categories; these
    are split as sets of categories instead of by order.
    """
    categorical = categorical or {}
    numbers = [c for c in columns if c not in categorical]
    rows = df.withColumns(
        {f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in numbers}
    ).withColumns(
        {f"_v_{c}": array_to_vector(F.transform(F.col(c), lambda x: x.cast("double")))
         for c in arrays}
    )
    inputs = [f"_n_{c}" for c in numbers] + [f"_v_{c}" for c in arrays] + list(vectors)
    if categorical:
        rows = rows.withColumns({f"_s_{c}": F.col(c).cast("string") for c in categorical})
        indexer = StringIndexerModel.from_arrays_of_labels(
            [[str(i) for i in range(n)] for n in categorical.values()],
            inputCols=[f"_s_{c}" for c in categorical],
            outputCols=[f"_c_{c}" for c in categorical],
            handleInvalid="keep",
        )
        rows = indexer.transform(rows)
        inputs += [f"_c_{c}" for c in categorical]
    helpers = [c for c in rows.columns if c not in df.columns]
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(rows).drop(*helpers)


# The two categorical inputs; every known category and "unknown".
CATEGORICAL_INPUTS = {
    "last_category_id": UNKNOWN_CATEGORY + 1,
    "mode_category_id": UNKNOWN_CATEGORY + 1,
}


# --- one multi-class boosted model ------------------------------------------------------------

def _boosting(settings: TreeSettings | bo.BoostSettings, early_stop: bool) -> bo.BoostSettings:
    """The settings as the boosting takes them."""
    if isinstance(settings, bo.BoostSettings):
        return settings if early_stop else replace(settings, patience=None, tolerance=None)
    return bo.BoostSettings(
        settings.name, "level", depth=settings.depth, rate=settings.step, l2=0.0, min_gain=settings.min_gain,
        min_rows=settings.min_rows, min_hessian=0.0, row_share=settings.rows,
        column_share=1.0 if settings.columns == "all" else float(settings.columns), rounds=settings.rounds,
        patience=None, bins=settings.bins, seed=settings.seed, loss="binary",
        tolerance=settings.tolerance if early_stop else None,
    )


def _categorical_slots(rows: DataFrame) -> list[int]:
    """Slots of the feature vector that hold categories."""
    attributes = rows.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    return [a["idx"] for a in attributes.get("nominal", [])]


def _fit(
    rows: DataFrame, settings: TreeSettings | bo.BoostSettings, folds: Sequence[int | None], keys: Sequence[str],
    weight: str | None, early_stop: bool, classes: int = NUM_CLASSES,
) -> list[bo.SoftmaxModel]:
    kind = _boosting(settings, early_stop)
    known = rows.filter(F.col("label").isNotNull() & F.col(FEATURES).isNotNull())
    bins = bo.fit_bins(known, kind.bins, categorical=_categorical_slots(rows))
    return bo.train_boosted(rows, [kind], folds, bins, keys, weight, classes=classes).models


def fit_boosted(
    rows: DataFrame, settings: TreeSettings | bo.BoostSettings, valid: str | None = None,
    weight: str | None = None, label: str = "label", classes: int = NUM_CLASSES, keys: Sequence[str] = ("row_id",),
) -> bo.SoftmaxModel:
    """One binary boosted model per class. With ``valid`` (a boolean column) the
    rounds stop early on those rows."""
    marked = rows.withColumns({
        "label": F.col(label), "fold": F.when(F.col(valid), 0).otherwise(-1) if valid else F.lit(-1)
    })
    return _fit(marked, settings, [0 if valid else None], keys, weight, bool(valid), classes)[0]


def predict_boosted(model: bo.SoftmaxModel, rows: DataFrame, prob: str = "prob") -> DataFrame:
    """Add the class probabilities as an array."""
    return bo.predict_boosted(rows, model, prob)


def _staged(model: bo.SoftmaxModel, rows: DataFrame, label: str, schema: str, emit: Callable) -> DataFrame:
    """What ``emit`` makes of a batch's labels and the margins after each round."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = shared.value.bins.place(np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1))
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            margins = np.tile(np.array(shared.value.start), (len(x), 1))
            for number, each in enumerate(shared.value.trees, 1):
                margins = margins + np.array([tree.outputs(x) for tree in each]).T
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in emit(number, labels, margins)], names=names)

    return rows.select(F.col(label).cast("int"), vector_to_array(FEATURES)).mapInArrow(run, schema)


def staged_metric(
    model: bo.SoftmaxModel, rows: DataFrame, label: str = "label"
) -> DataFrame:
    """Log loss of each class model on ``rows`` after each boosting round."""
    rounds = [model.rounds_of(c) for c in range(len(model.start))]

    def losses(number: int, labels: np.ndarray, margins: np.ndarray) -> list[np.ndarray]:
        classes = np.array([c for c, n in enumerate(rounds) if number <= n], dtype=np.int32)
        sign = np.where(labels[:, None] == classes, 1.0, -1.0)
        total = 2 * np.logaddexp(0, -2 * sign * margins[:, classes]).sum(axis=0)
        return [classes, np.full(len(classes), number, dtype=np.int32), total, np.full(len(classes), len(labels))]

    parts = _staged(model, rows, label, "class int, round int, total double, n bigint", losses)
    return parts.groupBy("class", "round").agg((F.sum("total") / F.sum("n")).alias("loss"))


def staged_macro_f1(
    model: bo.SoftmaxModel, rows: DataFrame, label: str = "label"
) -> DataFrame:
    """Weighted macro-F1 on ``rows`` after each boosting round.

    Classes whose boosting stopped earlier keep their last margin.
    """
    def predicted(number: int, labels: np.ndarray, margins: np.ndarray) -> list[np.ndarray]:
        return [labels.astype(np.int32), np.full(len(labels), number, dtype=np.int32), margins.argmax(axis=1).astype(np.int32)]

    long = _staged(model, rows, label, "target int, round int, predict int", predicted)
    return sc.weighted_macro_f1(long, by=["round"])


# --- cross-validation ----------------------------------------------------------------------------

@dataclass(frozen=True)
class CrossValidation:
    """Fold models, out-of-fold probabilities and scores of one kind of model."""

    name: str
    models: list[bo.SoftmaxModel] = field(repr=False)
    oof: DataFrame = field(repr=False)  # row key, label, fold, prob

    def scores(self) -> DataFrame:
        return sc.fold_scores(self.oof, {self.name: "prob"}, target="label")


def with_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights of the whole label column as ``weight``."""
    return fd.map_class_weight(rows, fd.balanced_class_weights(rows, label), label)


def cv_train(
    rows: DataFrame, settings: TreeSettings, k: int = fd.FOLDS, keys: Sequence[str] = ("row_id",),
) -> CrossValidation:
    """Fit one model per stored fold and predict each row by the model that has
    not seen it. ``rows`` has the keys, ``label``, ``fold`` and ``features``;
    training rows are weighted by class, validation rows are not.
    """
    models = _fit(with_weights(rows), settings, range(k), keys, "weight", True)
    return CrossValidation(settings.name, models, out_of_fold(rows, models, keys))


def fit_folds(
    rows: DataFrame, settings: TreeSettings | bo.BoostSettings, k: int = fd.FOLDS, weight: str | None = None,
    keys: Sequence[str] = ("row_id",),
) -> list[bo.SoftmaxModel]:
    """One model per fold on the rows outside it, all rounds, no early stop."""
    return _fit(rows, settings, range(k), keys, weight, False)


def out_of_fold(
    rows: DataFrame, models: Sequence[bo.SoftmaxModel], keys: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Probabilities of each row by its own fold's model (also replays saved ones)."""
    parts = [
        predict_boosted(model, fd.validation_rows(rows, fold)).select(
            *keys, "label", "fold", "prob"
        )
        for fold, model in enumerate(models)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def cv_predict(
    rows: DataFrame, models: Sequence[bo.SoftmaxModel], prob: str = "prob", how: str = "mean",
    divisor: float | None = None,
) -> DataFrame:
    """Mean (or sum, or sum over ``divisor``) of the fold models' probabilities.

    The models are applied side by side in one pass over the rows.
    """
    names = [f"_fold_{i}" for i in range(len(models))]
    scored = bo.predict_many(rows, models, names)
    parts = [F.col(name) for name in names]
    if how == "mean" and divisor is None:
        divisor = len(models)
    total = fx.array_total(parts)
    if divisor:
        total = F.transform(total, lambda x: x / F.lit(float(divisor)))
    return scored.withColumn(prob, total).select(*rows.columns, prob)


def save_models(models: Sequence[bo.SoftmaxModel], folder: str, name: str) -> None:
    """One directory per fold: ``{folder}/{name}_{fold}``."""
    for i, model in enumerate(models):
        bo.save_boosted([model], f"{folder.rstrip('/')}/{name}_{i}", SparkSession.active())


def load_models(folder: str, name: str, k: int = fd.FOLDS) -> list[bo.SoftmaxModel]:
    return [bo.load_boosted(SparkSession.active(), f"{folder.rstrip('/')}/{name}_{i}")[0] for i in range(k)]


# --- older trainer: categorical inputs, no early stop ------------------------------------------------

@dataclass(frozen=True)
class CategoricalTraining:
    models: list[bo.SoftmaxModel] = field(repr=False)
    train_scored: DataFrame = field(repr=False)
    valid_scored: DataFrame = field(repr=False)

    def pooled_f1(self) -> DataFrame:
        """Score over the concatenated training and validation predictions."""
        both = self.train_scored.withColumn("part", F.lit("train")).unionByName(
            self.valid_scored.withColumn("part", F.lit("valid"))
        )
        return sc.weighted_macro_f1(both, "label", "predict", by=["part"]).withColumn(
            "macro_f1", fx.round_half_even(F.col("macro_f1"), 4)
        )


def categorical_train(
    rows: DataFrame, settings: TreeSettings = replace(TREES_A, name="gbm", rows=1.0, columns="all"),
    k: int = fd.FOLDS, keys: Sequence[str] = ("row_id",),
) -> CategoricalTraining:
    """Fold models on a ``features`` vector with categorical slots; every fold
    also scores its own training rows."""
    models = fit_folds(with_weights(rows), settings, k, "weight", keys)

    def scored(pick: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        parts = [
            predict_boosted(m, pick(rows, i)).select(
                *keys, "label", fx.argmax(F.col("prob")).alias("predict")
            )
            for i, m in enumerate(models)
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    return CategoricalTraining(models, scored(fd.training_rows), scored(fd.validation_rows))


def categorical_predict(rows: DataFrame, models: Sequence[bo.SoftmaxModel]) -> DataFrame:
    """Class with the largest summed probability over the fold models."""
    summed = cv_predict(rows, models, how="sum")
    return summed.withColumn("predict", fx.argmax(F.col("prob"))).drop("prob")


# --- neural classifier -------------------------------------------------------------------------------

# Widths of the hidden layers.
HIDDEN_LAYERS = (256, 256, 128)


@dataclass(frozen=True)
class MlpTraining:
    scaler: MinMaxModel
    model: MultilayerPerceptronClassificationModel = field(repr=False)
    validation: DataFrame = field(repr=False)  # row key, label, predict

    def score(self) -> DataFrame:
        return sc.weighted_macro_f1(self.validation, "label", "predict")


def mlp_train(
    rows: DataFrame, values: str, keys: Sequence[str] = ("row_id",),
    hidden: Sequence[int] = HIDDEN_LAYERS, epochs: int = 100, step: float = 0.01,
    seed: int = 2022, solver: str = "gd", share: float = fd.HOLDOUT_SHARE,
    classes: int = NUM_CLASSES,
) -> MlpTraining:
    """Hold out a stratified share, scale by the training range, fit the network.

    ``values`` is a numeric array column.
    """
    split = fd.stratified_holdout(rows, keys, share=share)
    training = split.filter(~F.col("is_validation"))
    scaler = fit_min_max(training, values)

    def vectors(part: DataFrame) -> DataFrame:
        return part.select(
            *keys, "label", array_to_vector(scaler.transform(F.col(values))).alias(FEATURES)
        )

    network = MultilayerPerceptronClassifier(
        layers=[len(scaler.lows), *hidden, classes], maxIter=epochs, stepSize=step, seed=seed,
        solver=solver, featuresCol=FEATURES, labelCol="label",
    ).fit(vectors(training))
    predicted = network.transform(vectors(split.filter("is_validation"))).select(
        *keys, "label", F.col("prediction").cast("int").alias("predict")
    )
    return MlpTraining(scaler, network, predicted)
