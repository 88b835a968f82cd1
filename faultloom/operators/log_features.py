"""One feature row per fault from its capped, deduplicated history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from . import history
from .history import FAULT_KEY, MAX_MESSAGES, SLICED_FAULT_KEY
from .slices import WHOLE, SlicePlan

# Separator between messages of the merged text.
SEPARATOR_V2 = "。"
SEPARATOR_V1 = " "

_PER_MESSAGE = ["at_us", "ord", "time_ts", "server_model"]


def message_scalars(logs: DataFrame) -> DataFrame:
    """Category, category id, word and character count of each log message."""
    msg = fx.strip_delimiter(F.col("msg"))
    token = fx.category_token(msg)
    return logs.withColumns(
        {
            "category": token,
            "category_id": fx.dictionary_encode(token),
            "word_cnt": fx.word_count(msg),
            "char_cnt": fx.char_count(msg),
        }
    )


def capped_messages(
    faults: DataFrame, logs: DataFrame, plan: SlicePlan = WHOLE,
    strip_before_dedup: bool = True, max_messages: int = MAX_MESSAGES,
) -> DataFrame:
    """The oldest messages of each fault as numbers; the text itself is dropped
    before the join."""
    versions = history.message_versions(logs, plan, strip_before_dedup)
    msg = F.col("msg")
    numbers = versions.withColumns(
        {
            "category_id": fx.category_id(msg),
            "word_cnt": fx.word_count(msg),
            "char_cnt": fx.char_count(msg),
        }
    ).drop("msg")
    capped = history.cap_versions(numbers, max_messages, plan)
    return history.join_versions(
        faults, capped, plan, "cap_us", "cap_slice",
        [*_PER_MESSAGE, "category_id", "word_cnt", "char_cnt"],
    )


def per_category(messages: DataFrame) -> DataFrame:
    """Per fault, server model and category: sums that everything else needs.

    Statistics of the fault as a whole (last and most frequent category, span)
    ride along as window values over the fault. The window over the fault comes
    first, so one exchange by fault serves every later step.
    """
    fault = Window.partitionBy(*SLICED_FAULT_KEY)
    category = Window.partitionBy(*SLICED_FAULT_KEY, "category_id")
    last = F.max(F.struct("at_us", "ord", "category_id")).over(fault)
    rows = messages.withColumn("last_category_id", last["category_id"])
    cells = rows.groupBy(
        *SLICED_FAULT_KEY, "last_category_id", "server_model", "category_id"
    ).agg(
        F.count("*").alias("n"),
        F.sum("word_cnt").cast("bigint").alias("words"),
        F.sum("char_cnt").cast("bigint").alias("chars"),
        F.min("time_ts").alias("min_ts"),
        F.max("time_ts").alias("max_ts"),
    )
    # most frequent category, the smallest id on ties
    top = F.min(F.struct((-F.col("category_n")).alias("rank"), F.col("category_id"))).over(fault)
    return cells.withColumn("category_n", F.sum("n").over(category)).withColumns(
        {
            "mode_category_id": top["category_id"],
            "fault_n": F.sum("n").over(fault),
            "fault_min_ts": F.min("min_ts").over(fault),
            "fault_max_ts": F.max("max_ts").over(fault),
            "fault_words": F.sum("words").over(fault),
            "fault_chars": F.sum("chars").over(fault),
        }
    )


def category_statistics(messages: DataFrame) -> DataFrame:
    """Last and most frequent category of each fault and their shares."""
    cells = per_category(messages)
    return cells.groupBy(*SLICED_FAULT_KEY, "last_category_id", "mode_category_id").agg(
        F.first("fault_n").alias("log_cnt"),
        _share("last_category_id").alias("last_category_occupy"),
        _share("mode_category_id").alias("mode_category_occupy"),
        _distinct_categories().alias("category_nunique"),
    ).drop("slice", "cell", "fault_us")


def _distinct_categories():
    """Number of categories; a set of at most 35 ids needs no second aggregation."""
    return F.size(F.collect_set("category_id")).cast("bigint")


def _share(category: str):
    """Share of a group's messages that belong to the given category."""
    return F.sum(F.col("n") * fx.flag(F.col("category_id") == F.col(category))) / F.sum("n")


def time_gaps(messages: DataFrame) -> DataFrame:
    """Message count and the gaps between the fault and its history."""
    spans = messages.groupBy(*SLICED_FAULT_KEY).agg(
        F.count("*").alias("dup_log_cnt"),
        F.min("time_ts").alias("min_time_ts"),
        F.max("time_ts").alias("max_time_ts"),
    )
    gap = F.col("fault_time_ts") - F.col("min_time_ts")
    return spans.withColumns(
        {
            "dup_max_time_gap": gap,
            "dup_mean_time_gap": gap / F.col("dup_log_cnt"),
            "last_time_gap": F.col("fault_time_ts") - F.col("max_time_ts"),
            "fault_hour": F.hour("fault_time"),
        }
    ).drop("slice", "cell", "fault_us")


def merged_messages(
    faults: DataFrame, logs: DataFrame, plan: SlicePlan = WHOLE, per_model: bool = False,
    separator: str = SEPARATOR_V2, strip_before_dedup: bool = True,
) -> DataFrame:
    """All deduplicated messages of a fault in time order as one text, per fault
    or per fault and server model. The text is not capped."""
    versions = history.message_versions(logs, plan, strip_before_dedup)
    if per_model:
        versions = versions.filter("server_model is not null")
    keep = ["at_us", "ord", "msg"] + (["server_model"] if per_model else [])
    rows = history.join_versions(faults, versions, plan, keep=keep)
    keys = SLICED_FAULT_KEY + (["server_model"] if per_model else [])
    text = F.expr(f"listagg(msg, '{separator}') within group (order by at_us, ord)")
    return rows.groupBy(*keys).agg(text.alias("msg")).drop("slice", "cell", "fault_us")


def base_scalars_v2(messages: DataFrame) -> DataFrame:
    """Scalar features of the second generation from the capped messages.

    One row per fault and server model. Messages without a model count for the
    fault-wide statistics but form no row of their own.
    """
    per_model = (
        per_category(messages)
        .filter("server_model is not null")
        .groupBy(
            *SLICED_FAULT_KEY, "server_model", "last_category_id", "mode_category_id",
            "fault_n", "fault_min_ts", "fault_max_ts",
        )
        .agg(
            F.count("*").alias("category_nunique"),
            _share("last_category_id").alias("last_category_occupy"),
            _share("mode_category_id").alias("mode_category_occupy"),
            (F.sum("words") / F.sum("n")).alias("word_cnt_mean"),
            F.sum("words").alias("word_cnt_sum"),
            (F.sum("chars") / F.sum("n")).alias("char_cnt_mean"),
            F.sum("chars").alias("char_cnt_sum"),
            F.sum("n").alias("tail_log_cnt"),
            F.min("min_ts").alias("min_time_ts"),
        )
    )
    fault_ts = F.col("fault_time_ts")
    longest = fault_ts - F.col("fault_min_ts")
    tail_gap = fault_ts - F.col("min_time_ts")
    return per_model.withColumns(
        {
            "id": fx.fault_id(F.col("sn"), fault_ts, F.col("label")),
            "tail_max_time_gap": tail_gap,
            "tail_mean_time_gap": tail_gap / F.col("tail_log_cnt"),
            "dup_log_cnt": F.col("fault_n"),
            "dup_max_time_gap": longest,
            "dup_mean_time_gap": longest / F.col("fault_n"),
            "last_time_gap": fault_ts - F.col("fault_max_ts"),
            "fault_hour": F.hour("fault_time"),
        }
    ).drop("slice", "cell", "fault_us", "fault_n", "fault_min_ts", "fault_max_ts")


def base_scalars_v1(messages: DataFrame) -> DataFrame:
    """Scalar features of the first generation: one row per fault."""
    stats = per_category(messages).groupBy(
        *SLICED_FAULT_KEY, "last_category_id", "mode_category_id",
        "fault_n", "fault_min_ts", "fault_max_ts", "fault_words", "fault_chars",
    ).agg(
        _distinct_categories().alias("category_nunique"),
        _share("last_category_id").alias("last_category_occupy"),
        _share("mode_category_id").alias("mode_category_occupy"),
    )
    fault_ts, n = F.col("fault_time_ts"), F.col("fault_n")
    longest = fault_ts - F.col("fault_min_ts")
    return stats.withColumns(
        {
            "log_cnt": n,
            "last_time_gap": fault_ts - F.col("fault_max_ts"),
            "max_time_gap": longest,
            "mean_time_gap": longest / n,
            "word_cnt": F.col("fault_words") / n,
            "char_cnt": F.col("fault_chars") / n,
            "word_cnt_sum": F.col("fault_words").cast("double"),
            "char_cnt_sum": F.col("fault_chars").cast("double"),
        }
    ).drop(
        "slice", "cell", "fault_us", "fault_n", "fault_min_ts", "fault_max_ts",
        "fault_words", "fault_chars",
    )


def base_features_v2(
    faults: DataFrame, logs: DataFrame, plan: SlicePlan = WHOLE,
    max_messages: int = MAX_MESSAGES, missing_history: str = "drop",
) -> DataFrame:
    """Second-generation base features with the merged text as ``msg``.

    ``missing_history='keep'`` also returns faults without any earlier log,
    with null features; by default they are absent.
    """
    scalars = base_scalars_v2(capped_messages(faults, logs, plan, True, max_messages))
    texts = merged_messages(faults, logs, plan).drop("fault_time")
    features = scalars.join(texts, ["sn", "fault_time_ts", "label"], "left")
    return _with_missing(faults, features, missing_history)


def base_features_v1(
    faults: DataFrame, logs: DataFrame, plan: SlicePlan = WHOLE,
    max_messages: int = MAX_MESSAGES, missing_history: str = "drop",
) -> DataFrame:
    """First-generation base features: a row per fault and server model of the
    merged text, messages deduplicated with their delimiters."""
    scalars = base_scalars_v1(capped_messages(faults, logs, plan, False, max_messages))
    texts = merged_messages(
        faults, logs, plan, per_model=True, separator=SEPARATOR_V1, strip_before_dedup=False
    )
    features = texts.join(
        scalars.drop("fault_time"), ["sn", "fault_time_ts", "label"], "left"
    ).withColumn("fault_hour", F.hour("fault_time"))
    return _with_missing(faults, features, missing_history)


def _with_missing(faults: DataFrame, features: DataFrame, missing_history: str) -> DataFrame:
    if missing_history == "drop":
        return features
    if missing_history != "keep":
        raise ValueError("missing_history is 'drop' or 'keep'")
    keys = ["sn", "fault_time_ts", "label"]
    absent = history.fault_points(faults).select(*FAULT_KEY).join(features, keys, "left_anti")
    return features.unionByName(absent, allowMissingColumns=True)


def quality_report(logs: DataFrame) -> DataFrame:
    """Counts of log rows that cannot enter a history."""
    return logs.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("msg").isNull()).alias("null_msg"),
        F.count_if(F.col("sn").isNull()).alias("null_sn"),
        F.count_if(F.col("time").isNull()).alias("null_time"),
        F.count_if(F.col("server_model").isNull()).alias("null_server_model"),
    )
