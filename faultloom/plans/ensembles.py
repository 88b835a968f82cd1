"""Pseudo-labelling and stacking, composed from the cross-validation operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import boosting as bo
from ..operators import folds as fd
from ..operators import models as md
from ..operators import scores as sc
from ..session import materialize

# Fixed value: the summed probabilities of the five fold models are divided by
# four, so a class needs an average of 0.64 to reach the 0.8 gate.
PSEUDO_DIVISOR = 4


@dataclass(frozen=True)
class PseudoTraining:
    first: md.CrossValidation
    pseudo: DataFrame = field(repr=False)
    second: md.CrossValidation
    oof: DataFrame = field(repr=False)  # real rows only

    def score(self) -> DataFrame:
        scored = self.oof.withColumn("predict", fx.argmax(F.col("prob")))
        return sc.weighted_macro_f1(scored, "label", "predict")


def pseudo_label_train(
    labelled: DataFrame, unlabelled: DataFrame, settings: md.TreeSettings,
    first_settings: md.TreeSettings = md.TREES_A, keys: Sequence[str] = ("row_id",),
    divisor: float = PSEUDO_DIVISOR, k: int = fd.FOLDS,
) -> PseudoTraining:
    """Train on the labelled rows, add the unlabelled rows it is sure about, and
    train again on both; the final score counts real rows only.

    Both tables have the keys and ``features``; ``labelled`` also ``label`` and
    ``fold``. Keys must be unique over both.
    """
    first = md.cv_train(labelled, first_settings, k, keys)
    guessed = md.cv_predict(
        unlabelled.select(*keys, md.FEATURES), first.models, how="sum", divisor=divisor
    )
    pseudo = materialize(sc.confident_rows(guessed).select(*keys, md.FEATURES, "label"))
    union = sc.append_pseudo(labelled.select(*keys, md.FEATURES, "label"), pseudo)
    union = materialize(fd.stratified_folds(union, keys, k=k))
    second = md.cv_train(union, settings, k, keys)
    return PseudoTraining(first, pseudo, second, sc.without_pseudo(second.oof, pseudo, keys))


@dataclass(frozen=True)
class StackedTraining:
    base: list[md.CrossValidation]
    final: md.CrossValidation

    def scores(self) -> DataFrame:
        table = self.final.scores()
        for cv in self.base:
            table = table.unionByName(cv.scores())
        return table


def stacking_train(
    rows: DataFrame, settings: Sequence[md.TreeSettings] = md.ENSEMBLE,
    final_settings: md.TreeSettings = replace(md.TREES_A, name="stacker"),
    keys: Sequence[str] = ("row_id",), k: int = fd.FOLDS,
) -> StackedTraining:
    """Out-of-fold probabilities of every base model join the features of a
    second-level model on the row key."""
    base = [md.cv_train(rows, s, k, keys) for s in settings]
    meta = rows
    for cv in base:
        part = cv.oof.select(*keys, array_to_vector("prob").alias(f"_meta_{cv.name}"))
        meta = meta.join(part, list(keys))
    inputs = [md.FEATURES, *[f"_meta_{cv.name}" for cv in base]]
    stacked = VectorAssembler(inputCols=inputs, outputCol="_stacked").transform(meta)
    stacked = stacked.select(*keys, "label", "fold", F.col("_stacked").alias(md.FEATURES))
    return StackedTraining(base, md.cv_train(materialize(stacked), final_settings, k, keys))


@dataclass(frozen=True)
class Stacker:
    """Stacks predicted labels: each base model's out-of-fold label is a feature
    of the final model; for new rows the mean of its fold models' labels.

    The kinds are fitted one after the other, so that the driver holds the trees and splits
    of one kind's folds while they grow; none of them stops early."""

    base: Sequence[md.TreeSettings | bo.BoostSettings]
    final: md.TreeSettings | bo.BoostSettings
    k: int = fd.FOLDS

    def fit_predict(
        self, rows: DataFrame, new_rows: DataFrame, keys: Sequence[str] = ("row_id",)
    ) -> DataFrame:
        """Predicted class per new row, as ``keys, predict``."""
        rows = materialize(fd.plain_folds(rows, keys, k=self.k))
        fitted = [md.fit_folds(rows, settings, self.k, keys=keys) for settings in self.base]
        models = [model for kind in fitted for model in kind]
        names = [f"_p_{i}" for i in range(len(models))]

        def labels(kind: int) -> list[Column]:
            return [fx.argmax(F.col(names[kind * self.k + fold])) for fold in range(self.k)]

        own = bo.predict_many(rows, models, names)
        meta = own.select(*keys, "label", array_to_vector(F.array(*[
            F.element_at(F.array(*labels(i)), F.col("fold") + 1).cast("double")
            for i in range(len(fitted))])).alias(md.FEATURES))
        new = bo.predict_many(new_rows.select(*keys, md.FEATURES), models, names)
        new_meta = new.select(*keys, array_to_vector(F.array(*[
            reduce(add, labels(i)) / F.lit(float(self.k)) for i in range(len(fitted))])).alias(md.FEATURES))
        final = md.fit_boosted(materialize(meta), self.final, keys=keys)
        scored = md.predict_boosted(final, new_meta)
        return scored.select(*keys, fx.argmax(F.col("prob")).alias("predict"))
