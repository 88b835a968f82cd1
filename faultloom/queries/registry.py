"""The registered queries: every operator over the given tables.

Doubles are rounded to six digits, so that both engines of the check agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from uuid import uuid4

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import boosting as bo
from ..operators import encoding as enc
from ..operators import folds as fd
from ..operators import history as hs
from ..operators import log_features as lf
from ..operators import models as md
from ..operators import scaling
from ..operators import scores as sc
from ..operators import text as tx
from ..plans import ensembles, pipeline
from ..session import ensure_checkpoint_dir, materialize
from ..sources import readers, writers
from . import fixtures as fixt

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

FAULT = ["sn", "fault_time_ts", "label"]
DIGITS = 6
STACK_ROUNDS = 100  # of the models that do not stop early


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, DIGITS)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns rounded."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: r6(c) for c in doubles})


def _vocabulary(table: DataFrame) -> DataFrame:
    return table.select("term", "term_idx", "df", r6("idf").alias("idf"), "n_docs")


def _fixture(spark: SparkSession, sf_dir: str):
    faults, logs = fixt.faults(spark, sf_dir), fixt.logs(spark, sf_dir)
    return faults, logs, hs.slice_plan(faults, logs)


def _capped(spark: SparkSession, sf_dir: str, strip: bool = True) -> DataFrame:
    faults, logs, plan = _fixture(spark, sf_dir)
    return lf.capped_messages(faults, logs, plan, strip)


# --- sources and sinks -----------------------------------------------------------------

def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


@register
def faults_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and unlabelled faults through CSV files and back."""
    labelled, submit = _scratch(spark, "faults"), _scratch(spark, "submit")
    writers.write_predictions(fixt.faults(spark, sf_dir), labelled)
    writers.write_predictions(fixt.submit(spark, sf_dir).withColumn("label", F.lit(0)), submit)
    rows = readers.read_faults(spark, labelled).unionByName(
        readers.read_faults(spark, [submit], training=False)
    )
    return rows.select(*FAULT, F.hour("fault_time").alias("fault_hour"))


@register
def logs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows through two CSV files and back."""
    logs = fixt.logs(spark, sf_dir).select("sn", "time", "msg", "server_model")
    paths = [_scratch(spark, "logs"), _scratch(spark, "logs")]
    writers.write_features(logs.filter("server_model < 'SM5'"), paths[0], "csv")
    writers.write_features(logs.filter("server_model >= 'SM5'"), paths[1], "csv")
    rows = readers.read_logs(spark, paths)
    place = F.row_number().over(Window.partitionBy("sn").orderBy("ord"))
    return rows.select("sn", "time_ts", "msg", "server_model", place.alias("place"))


@register
def crashdump_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash-dump records, one a log row, through a CSV file and back."""
    path = _scratch(spark, "crashdump")
    logs = fixt.logs(spark, sf_dir).select("sn", F.col("time").alias("fault_time"), F.col("msg").alias("fault_code"))
    writers.write_features(logs, path, "csv")
    return readers.read_crashdump(spark, path).select("sn", fx.epoch_seconds(F.col("fault_time")).alias("ts"), "fault_code")


@register
def venus_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module-cause records, one a log row, through two CSV files and back; one of the
    files lacks a column."""
    paths = [_scratch(spark, "venus"), _scratch(spark, "venus")]
    logs = fixt.logs(spark, sf_dir).select(
        "sn", F.col("time").alias("fault_time"), F.col("msg").alias("module_cause"), F.col("server_model").alias("module"))
    writers.write_features(logs.filter("module < 'SM5'"), paths[0], "csv")
    writers.write_features(logs.filter("module >= 'SM5'").drop("module"), paths[1], "csv")
    return readers.read_venus(spark, paths).select(
        "sn", fx.epoch_seconds(F.col("fault_time")).alias("ts"), "module_cause", "module")


@register
def features_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar features written and read back as model inputs."""
    path = _scratch(spark, "features")
    writers.write_features(lf.base_scalars_v2(_capped(spark, sf_dir)), path)
    return rounded(readers.read_features(spark, path, SCALARS, keys=["sn", "fault_time_ts", "server_model"]))


@register
def encoding_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target encoding written and read back."""
    path = _scratch(spark, "encoding")
    writers.save_encoding(enc.fit_encoding(materialize(_models_of(spark, sf_dir))), path)
    return rounded(writers.load_encoding(spark, path))


@register
def tfidf_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text model written and read back."""
    path = _scratch(spark, "tfidf")
    writers.save_tfidf(tx.fit_tfidf(fixt.documents(spark, sf_dir)), spark, path)
    return _vocabulary(writers.load_tfidf(spark, path).to_df(spark))


@register
def sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of both inputs, and whether they come out in order."""
    def in_order(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        path = _scratch(spark, "sorted")
        # a sorted table is written in the order of its part files
        df.select(*keys).write.parquet(path)
        rows = spark.read.parquet(path).select(
            *keys, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        ends = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("low"),
                                                 F.max(F.struct(*keys)).alias("high"))
        # a row a file: each begins no earlier than the one before it ends
        after = F.lag("high").over(Window.orderBy("file", "start"))
        return ends.withColumn("fine", F.coalesce(after <= F.col("low"), F.lit(True))).agg(
            F.sum("n").alias("n_rows"), F.every("fine").alias("in_order")).select(F.lit(name).alias("name"), "n_rows", "in_order")

    faults = in_order(readers.sort_faults(fixt.faults(spark, sf_dir)), "faults", ["sn", "fault_time", "label"])
    return faults.unionByName(in_order(readers.sort_logs(fixt.logs(spark, sf_dir)), "logs", ["sn", "time", "ord"]))


# --- history --------------------------------------------------------------------------

@register
def fault_history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.fault_history(*_fixture(spark, sf_dir)).drop("fault_time")


@register
def fault_history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.dedup_totals(*_fixture(spark, sf_dir)).drop("fault_time")


@register
def fault_history_dedup_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.dedup_totals(*_fixture(spark, sf_dir), strip_before_dedup=False).drop("fault_time")


@register
def message_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, logs, plan = _fixture(spark, sf_dir)
    return hs.message_versions(logs, plan).select(
        "sn", "ord", "time_ts", "msg", F.coalesce("next_us", F.lit(-1)).alias("next_us")
    )


@register
def fault_history_first40(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults, logs, plan = _fixture(spark, sf_dir)
    rows = hs.first_messages(faults, logs, hs.MAX_MESSAGES, plan)
    return rows.withColumn("position", hs.earliest_rank()).select(
        *FAULT, "position", "time_ts", "msg", "server_model"
    )


@register
def train_fault_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = fixt.all_faults(spark, sf_dir)
    return hs.distinct_faults(faults.unionByName(faults)).select(*FAULT)


# --- features ---------------------------------------------------------------------------

@register
def log_scalar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.message_scalars(fixt.logs(spark, sf_dir)).select(
        "ord", "category", "category_id", "word_cnt", "char_cnt",
        F.hour("time").alias("log_hour"),
    )


@register
def category_last_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lf.category_statistics(_capped(spark, sf_dir)).drop("fault_time"))


@register
def time_gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lf.time_gaps(_capped(spark, sf_dir)).drop("fault_time"))


@register
def base_features_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lf.base_features_v2(*_fixture(spark, sf_dir)).drop("fault_time"))


@register
def base_features_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lf.base_features_v1(*_fixture(spark, sf_dir)).drop("fault_time"))


@register
def scalar_features_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lf.base_scalars_v2(_capped(spark, sf_dir)).drop("fault_time"))


@register
def merged_message_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.merged_messages(*_fixture(spark, sf_dir)).drop("fault_time")


@register
def merged_message_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.merged_messages(
        *_fixture(spark, sf_dir), per_model=True, separator=lf.SEPARATOR_V1,
        strip_before_dedup=False,
    ).drop("fault_time")


# --- encoding ---------------------------------------------------------------------------

def _models_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault rows with their server model, as the encoding is fitted on."""
    return lf.base_scalars_v2(_capped(spark, sf_dir)).select(*FAULT, "server_model")


@register
def label_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(enc.label_prior(fixt.faults(spark, sf_dir)))


@register
def server_model_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_models_of(spark, sf_dir))
    return rounded(enc.fit_encoding(rows))


@register
def encoding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of the labelled faults, attached to every log row's model."""
    encoding = materialize(enc.fit_encoding(materialize(_models_of(spark, sf_dir))))
    logs = fixt.logs(spark, sf_dir).select("ord", "server_model")
    return rounded(enc.apply_encoding(logs, encoding)).drop("sm_encoding_weighted_sum")


# --- text --------------------------------------------------------------------------------

@register
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixt.documents(spark, sf_dir)
    model = tx.fit_tfidf(docs)
    return _vocabulary(model.to_df(spark))


@register
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.term_counts(fixt.documents(spark, sf_dir))


@register
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixt.documents(spark, sf_dir)
    return tx.tfidf_long(docs, tx.fit_tfidf(docs), ["doc_id"]).withColumn("weight", r6("weight"))


@register
def fault_text_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary over the merged messages of the faults."""
    texts = materialize(lf.merged_messages(*_fixture(spark, sf_dir)).select("msg"))
    return _vocabulary(tx.fit_tfidf(texts, "msg").to_df(spark))


@register
def word2vec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixt.documents(spark, sf_dir)
    model = tx.fit_word2vec(docs)
    return tx.transform_word2vec(docs, model).select(
        "doc_id", vector_to_array("w2v").alias("w2v")
    )


# --- folds and weights ---------------------------------------------------------------------

def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixt.labelled_vectors(spark, sf_dir).select("row_id", "label")


@register
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.stratified_folds(_labels(spark, sf_dir))


@register
def stratified_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fd.stratified_folds(_labels(spark, sf_dir))
    return rows.groupBy("label", "fold").agg(F.count("*").alias("cnt"))


@register
def plain_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.plain_folds(_labels(spark, sf_dir))


@register
def plain_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.plain_folds(_labels(spark, sf_dir)).groupBy("fold").agg(F.count("*").alias("cnt"))


@register
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.stratified_holdout(_labels(spark, sf_dir))


@register
def stratified_holdout_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fd.stratified_holdout(_labels(spark, sf_dir))
    return rows.groupBy("label").agg(
        F.count_if("is_validation").alias("validation_cnt"),
        F.count_if(~F.col("is_validation")).alias("training_cnt"),
    )


@register
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fd.balanced_class_weights(_labels(spark, sf_dir)))


@register
def row_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir)
    return rounded(fd.map_class_weight(rows, fd.balanced_class_weights(rows)))


@register
def distinct_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.distinct_classes(_labels(spark, sf_dir))


@register
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixt.labelled_vectors(spark, sf_dir)
    model = scaling.fit_min_max(rows, "embedding")
    scaled = model.transform(F.col("embedding"))
    return rows.select("row_id", F.posexplode(scaled).alias("position", "value")).withColumn(
        "value", r6("value")
    )


# --- scores ---------------------------------------------------------------------------------

def _probs() -> list[Column]:
    return [F.col(f"prob_{m}") for m in "abc"]


def _spread(prob: Column) -> list[Column]:
    return [r6(prob[c]).alias(f"p{c}") for c in range(fx.NUM_CLASSES)]


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixt.scores(spark, sf_dir).withColumn("predict", fx.argmax(F.col("prob_a")))


@register
def softmax_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixt.scores(spark, sf_dir).select("row_id", *_spread(F.col("prob_a")))


@register
def sigmoid_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixt.scores(spark, sf_dir).select(
        "row_id", fx.sigmoid(F.col("logit_a")).alias("s"), fx.one_hot(F.col("target")).alias("h")
    )
    return rows.select(
        "row_id", *[r6(F.col("s")[c]).alias(f"s{c}") for c in range(4)],
        *[F.col("h")[c].alias(f"h{c}") for c in range(4)],
    )


@register
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.confusion_counts(_predicted(spark, sf_dir))


@register
def weighted_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.weighted_macro_f1(_predicted(spark, sf_dir)))


@register
def weighted_macro_f1_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        sc.weighted_macro_f1(_predicted(spark, sf_dir), weights=sc.ALTERNATIVE_CLASS_WEIGHTS)
    )


@register
def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.prediction_counts(_predicted(spark, sf_dir))


def _pooled_as_minus_one(scores: DataFrame) -> DataFrame:
    return rounded(scores).withColumn("fold", F.coalesce("fold", F.lit(-1)))


@register
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled_as_minus_one(
        sc.fold_scores(fixt.scores(spark, sf_dir), {m: f"prob_{m}" for m in "abc"})
    )


@register
def fold_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sc.fold_scores(fixt.scores(spark, sf_dir), {m: f"prob_{m}" for m in "abc"})
    return rounded(sc.fold_score_summary(scores))


@register
def blend_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled_as_minus_one(
        pipeline.scoreboard(fixt.scores(spark, sf_dir), "abc", "target")
    )


def _blend(spark: SparkSession, sf_dir: str, blended: Column) -> DataFrame:
    rows = fixt.scores(spark, sf_dir).withColumn("prob", blended)
    return rows.select("row_id", *_spread(F.col("prob")), fx.argmax(F.col("prob")).alias("predict"))


@register
def blend_equal2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend(spark, sf_dir, fx.blend(_probs()[:2], pipeline.EQUAL_TWO))


@register
def blend_equal3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend(spark, sf_dir, fx.blend_mean(_probs()))


@register
def blend_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend(spark, sf_dir, fx.blend(_probs(), pipeline.WEIGHTED_THREE))


@register
def ordinal_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixt.scores(spark, sf_dir).select("row_id", fx.ordinal_vote(_probs()).alias("label"))


def _long_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixt.scores(spark, sf_dir).select("row_id", F.explode(F.array(*_probs())).alias("prob"))


@register
def fold_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.fold_average(_long_probs(spark, sf_dir)).select("row_id", *_spread(F.col("prob")))


@register
def fold_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.fold_average(_long_probs(spark, sf_dir), how="sum").select(
        "row_id", *_spread(F.col("prob")), fx.argmax(F.col("prob")).alias("predict")
    )


@register
def pseudo_label_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident rows appended to the labelled ones, with their origin."""
    rows = fixt.scores(spark, sf_dir)
    pseudo = sc.confident_rows(rows, "prob_a").select("row_id", "label")
    real = rows.select("row_id", F.col("target").alias("label"))
    return sc.append_pseudo(real, pseudo)


@register
def pseudo_label_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixt.scores(spark, sf_dir)
    return sc.without_pseudo(
        rows.select("row_id", "target"), sc.confident_rows(rows, "prob_a"), ["row_id"]
    )


@register
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.focal_loss(fixt.scores(spark, sf_dir), "logit_a"))


@register
def focal_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.focal_gradient(fixt.scores(spark, sf_dir), "logit_a")
    return rounded(rows.drop("hess"))


@register
def focal_grad_hess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.focal_gradient(fixt.scores(spark, sf_dir), "logit_a"))


@register
def extreme_logit_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both losses with logits a thousand times as large."""
    rows = fixt.scores(spark, sf_dir).withColumn(
        "logit_a", F.transform("logit_a", lambda x: x.cast("double") * 1000))
    losses = {"focal": sc.focal_loss(rows, "logit_a"), "softmax": sc.softmax_log_loss(rows, "logit_a")}
    parts = [df.toDF("value").select(F.lit(name).alias("loss"), "value") for name, df in losses.items()]
    return rounded(parts[0].unionByName(parts[1]))


@register
def softmax_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.softmax_log_loss(fixt.scores(spark, sf_dir), "logit_a"))


@register
def ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed event value per user, in event order."""
    events = fixt.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    steps = sc.with_steps(events, ["user_id"], "event_id")
    return rounded(sc.final_ema(steps, ["user_id"]))


# --- training ----------------------------------------------------------------------------------

def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = md.assemble(fixt.labelled_vectors(spark, sf_dir), arrays=["embedding"])
    return materialize(fd.stratified_folds(rows.select("row_id", "label", md.FEATURES)))


def _oof_columns(oof: DataFrame) -> DataFrame:
    return oof.select(
        "row_id", "label", "fold", *_spread(F.col("prob")), fx.argmax(F.col("prob")).alias("predict")
    )


@register
def cv_train_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oof_columns(md.cv_train(_training_rows(spark, sf_dir), md.TREES_A).oof)


@register
def cv_replay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold scores of models that went to storage and back."""
    rows = _training_rows(spark, sf_dir)
    folder = _scratch(spark, "models")
    md.save_models(md.cv_train(rows, md.TREES_B).models, folder, "b")
    oof = md.out_of_fold(rows, md.load_models(folder, "b"))
    return _pooled_as_minus_one(sc.fold_scores(oof, {"b": "prob"}, "label"))


@register
def cv_predict_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fold probabilities of all kinds of model, blended."""
    rows = _training_rows(spark, sf_dir)
    scored = rows
    for kind in md.ENSEMBLE:
        scored = md.cv_predict(scored, md.cv_train(rows, kind).models, f"prob_{kind.name}")
    weights = [1.0 / len(md.ENSEMBLE)] * len(md.ENSEMBLE)
    prob = fx.blend([F.col(f"prob_{kind.name}") for kind in md.ENSEMBLE], weights)
    return scored.select("row_id", *_spread(prob), fx.argmax(prob).alias("predict"))


@register
def staged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation macro-F1 of every fold's model after each boosting round."""
    rows = _training_rows(spark, sf_dir)
    staged = [
        md.staged_macro_f1(model, fd.validation_rows(rows, fold)).withColumn("fold", F.lit(fold))
        for fold, model in enumerate(md.cv_train(rows, md.TREES_A).models)
    ]
    return rounded(reduce(DataFrame.unionByName, staged))


def _fault_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar fault features with a row id and stored folds."""
    rows = lf.base_scalars_v2(_capped(spark, sf_dir)).withColumn(
        "row_id", F.concat_ws("-", "id", "server_model")
    )
    return materialize(fd.stratified_folds(rows))


SCALARS = (
    "last_category_id", "mode_category_id", "last_time_gap", "last_category_occupy",
    "mode_category_occupy", "category_nunique", "fault_hour", "dup_log_cnt",
    "dup_max_time_gap", "dup_mean_time_gap", "word_cnt_mean", "char_cnt_mean",
)


@register
def categorical_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled training and validation score with categorical inputs."""
    rows = md.assemble(
        _fault_rows(spark, sf_dir), SCALARS, categorical=md.CATEGORICAL_INPUTS
    ).select("row_id", "label", "fold", md.FEATURES)
    return md.categorical_train(materialize(rows)).pooled_f1()


@register
def pseudo_label_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled faults, and the unlabelled ones that the first models are sure about."""
    labelled = md.assemble(_fault_rows(spark, sf_dir), SCALARS).select(
        "row_id", "label", "fold", md.FEATURES
    )
    submit, logs = fixt.submit(spark, sf_dir), fixt.logs(spark, sf_dir)
    features = lf.base_scalars_v2(lf.capped_messages(submit, logs, hs.slice_plan(submit, logs)))
    unlabelled = md.assemble(features, SCALARS).select(
        F.concat_ws("-", F.lit("submit"), "id", "server_model").alias("row_id"), md.FEATURES
    )
    run = ensembles.pseudo_label_train(materialize(labelled), materialize(unlabelled), md.TREES_B)
    return _oof_columns(run.oof)


@register
def stacking_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ensembles.stacking_train(_training_rows(spark, sf_dir))
    return _oof_columns(run.final.oof)


@register
def generic_stacker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training_rows(spark, sf_dir).drop("fold")
    base = [replace(kind, rounds=STACK_ROUNDS) for kind in (bo.BOOST_C, bo.BOOST_B, bo.BOOST_A)]
    return ensembles.Stacker(base, base[0]).fit_predict(rows, rows.drop("label"))


def _whole(kind: bo.BoostSettings) -> bo.BoostSettings:
    """Without samples of rows and columns, which SQL could not follow."""
    return replace(kind, row_share=1.0, column_share=1.0)


def _weighted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixt.labelled_vectors(spark, sf_dir).withColumnRenamed("embedding", bo.FEATURES)
    return md.with_weights(rows)


@register
def boost_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient and hessian sums of the first round by class, feature and bin."""
    cells, _ = bo.first_round(_weighted_vectors(spark, sf_dir), _whole(bo.BOOST_B), weight="weight")
    # sums of binary fractions: six digits would cut in the middle of some
    return cells.withColumns({"g": F.round("g", 9), "h": F.round("h", 9)})


def _splits(split: DataFrame) -> DataFrame:
    left = F.array_join(F.transform("left", lambda i: i.cast("string")), ",")
    return rounded(split.withColumn("left", left))


@register
def boost_first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best split of each class's first tree: gain, feature, bins that go left."""
    return _splits(bo.first_round(_weighted_vectors(spark, sf_dir), _whole(bo.BOOST_B), weight="weight")[1])


@register
def boost_category_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best set of categories of each class's first tree: categories by gradient order."""
    rows = lf.category_statistics(_capped(spark, sf_dir)).withColumn(
        bo.FEATURES, F.array("last_category_id", "mode_category_id"))
    bins = bo.Bins(((), ()), frozenset((0, 1)), size=64)
    return _splits(bo.first_round(rows, _whole(bo.BOOST_A), bins, row_id=FAULT)[1])


@register
def ordered_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares of each fault's last category among earlier faults of a random order."""
    rows = lf.category_statistics(_capped(spark, sf_dir)).select(*FAULT, "last_category_id", "mode_category_id")
    found = enc.ordered_statistics(rows, "last_category_id", [*FAULT, "last_category_id", "mode_category_id"])
    return found.select(*FAULT, "last_category_id", "mode_category_id",
                        *[r6(F.col("statistic")[c]).alias(f"s{c}") for c in range(4)])


@register
def boosted_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 of the held-out rows after each round of softmax boosting, up to the end
    of its patience, and the round that is kept."""
    rows = md.with_weights(_training_rows(spark, sf_dir))
    training = bo.train_boosted(rows, [bo.BOOST_B], range(fd.FOLDS), weight="weight")
    return rounded(training.staged_table(spark))


@register
def mlp_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixt.labelled_vectors(spark, sf_dir)
    return md.mlp_train(rows, "embedding").validation


@register
def pipeline_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, training on the labelled faults, vote on the unlabelled ones."""
    logs = fixt.logs(spark, sf_dir)
    run = pipeline.train(fixt.faults(spark, sf_dir), logs)
    models = {name: cv.models for name, cv in run.runs.items()}
    predicted = pipeline.predict(fixt.submit(spark, sf_dir), logs, run.artifacts, models)
    return predicted.drop("fault_time")
