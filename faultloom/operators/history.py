"""Fault x log history without building the pairs.

Every fault sees the log rows of its server up to and including its own time.
Three facts keep this linear in the input:

* the history of a fault is a prefix of the server's time-ordered log, so its
  length identifies it (:func:`fault_history`);
* of equal messages only the latest counts, so one occurrence stands for its
  message exactly until the next one: an interval (:func:`message_versions`);
* an occurrence belongs to the oldest ``n`` only after enough older ones have
  ended, again an interval (:func:`cap_versions`); at any time at most ``n`` of
  these are open, so joining faults to them gives at most ``n`` rows per fault.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..session import materialize
from .slices import WHOLE, SlicePlan, plan_slices

FAULT_KEY = ["sn", "fault_time", "fault_time_ts", "label"]
SLICED_FAULT_KEY = ["sn", "slice", "cell", "fault_us", *FAULT_KEY[1:]]
MAX_MESSAGES = 40
FAULTS_PER_CELL = 256
_NEVER = 2**62  # "no end", beyond any timestamp


def fault_points(faults: DataFrame) -> DataFrame:
    """Distinct fault keys with their instant; rows that can match nothing go."""
    return (
        faults.filter(F.col("sn").isNotNull() & F.col("fault_time").isNotNull())
        .select(*FAULT_KEY)
        .dropDuplicates()
        .withColumn("at_us", fx.epoch_micros(F.col("fault_time")))
    )


def log_points(logs: DataFrame) -> DataFrame:
    """Log rows that can belong to a history, with their instant."""
    return logs.filter(
        F.col("sn").isNotNull() & F.col("time").isNotNull() & F.col("msg").isNotNull()
    ).select(
        "sn", fx.epoch_micros(F.col("time")).alias("at_us"), "time_ts", "ord", "msg", "server_model"
    )


def slice_plan(faults: DataFrame, logs: DataFrame, **options) -> SlicePlan:
    """Slices for the hot servers of one fault / log pair of tables."""
    instants = [
        table.filter(F.col("sn").isNotNull() & F.col(time).isNotNull()).select(
            "sn", fx.epoch_micros(F.col(time)).alias("at_us")
        )
        for table, time in ((faults, "fault_time"), (logs, "time"))
    ]
    return plan_slices(instants, **options)


# --- the history as a prefix --------------------------------------------------

def running_totals(
    faults: DataFrame, steps: DataFrame, measures: list[str], plan: SlicePlan = WHOLE
) -> DataFrame:
    """For each fault the sum of every measure over the steps of its server up
    to its time. ``steps`` has ``sn, at_us`` and integer measures."""
    zero = {m: F.lit(0).cast("bigint") for m in measures}
    steps = plan.assign(steps).select(
        "sn", "slice", "at_us", *[F.col(m).cast("bigint").alias(m) for m in measures]
    )
    if plan.has_hot_servers:
        # copies of one instant cannot be sliced apart: combine them on the map side
        steps = steps.groupBy("sn", "slice", "at_us").agg(*[F.sum(m).alias(m) for m in measures])
    points = plan.assign(fault_points(faults)).drop("n_slices")
    fault_cols = [c for c in points.columns if c not in ("sn", "slice", "at_us")]
    events = points.withColumns({**zero, "is_fault": F.lit(True)}).unionByName(
        steps.withColumn("is_fault", F.lit(False)), allowMissingColumns=True
    )
    so_far = (
        Window.partitionBy(*plan.keys).orderBy("at_us")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = events.withColumns({m: F.sum(m).over(so_far) for m in measures}).filter("is_fault")
    if plan.has_hot_servers:
        earlier = (
            Window.partitionBy("sn").orderBy("slice")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        # one row per slice of a hot server, faults included so none is missing
        per_slice = events.groupBy("sn", "slice").agg(*[F.sum(m).alias(m) for m in measures])
        carry = per_slice.select(
            "sn", "slice",
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"carry_{m}") for m in measures],
        )
        totals = totals.join(carry, ["sn", "slice"]).withColumns(
            {m: F.col(m) + F.col(f"carry_{m}") for m in measures}
        )
    return totals.select("sn", *fault_cols, "at_us", *measures)


def fault_history(faults: DataFrame, logs: DataFrame, plan: SlicePlan = WHOLE) -> DataFrame:
    """Each fault with the length and the span of its history.

    This is the whole join in lossless form: the rows of a fault are the first
    ``history_cnt`` rows of its server's log. Faults without history drop out.
    """
    steps = log_points(logs).select("sn", "at_us", F.lit(1).alias("history_cnt"),
                                    fx.char_count(F.col("msg")).alias("history_chars"),
                                    F.col("time_ts").alias("history_ts_sum"))
    totals = running_totals(
        faults, steps, ["history_cnt", "history_chars", "history_ts_sum"], plan
    )
    return totals.filter("history_cnt > 0").withColumn(
        "id", fx.fault_id(F.col("sn"), F.col("fault_time_ts"), F.col("label"))
    ).drop("at_us")


def history_pairs(faults: DataFrame, logs: DataFrame) -> DataFrame:
    """The history written out, one row per fault and earlier log row.

    Its size is its output, so no other operator uses it; pass the few faults
    whose history is to be looked at.
    """
    left = fault_points(faults).withColumnRenamed("at_us", "fault_us").alias("f")
    right = log_points(logs).alias("l")
    return left.join(
        right, (F.col("f.sn") == F.col("l.sn")) & (F.col("l.at_us") <= F.col("f.fault_us"))
    ).select("f.*", "l.at_us", "l.time_ts", "l.ord", "l.msg", "l.server_model")


# --- latest occurrence of each message, as intervals ---------------------------

def message_versions(
    logs: DataFrame, plan: SlicePlan = WHOLE, strip_before_dedup: bool = True
) -> DataFrame:
    """One row per message occurrence with the interval ``[at_us, next_us)`` in
    which it is the latest of its message (``next_us`` null: for good).

    Messages are compared without the field delimiter (second feature
    generation) or with it (first generation); ``msg`` is always stripped.
    """
    stripped = fx.strip_delimiter(F.col("msg"))
    rows = log_points(logs)
    if strip_before_dedup:
        same, rows = "msg", rows.withColumn("msg", stripped)
    else:
        same, rows = "raw_msg", rows.withColumns({"raw_msg": F.col("msg"), "msg": stripped})
    rows = plan.assign(rows)
    if plan.has_hot_servers:
        # copies within one instant would pile up in one slice: combine them first
        rows = (
            rows.groupBy("sn", "slice", "n_slices", "at_us", *dict.fromkeys([same, "msg"]))
            .agg(F.max(F.struct("ord", "server_model", "time_ts")).alias("last"))
            .select("sn", "slice", "n_slices", "at_us", *dict.fromkeys([same, "msg"]), "last.*")
        )
    else:
        # one exchange serves the window, the cap and the join with the faults
        rows = rows.repartition("sn")
    next_one = Window.partitionBy(*plan.keys, same).orderBy("at_us", "ord")
    rows = rows.withColumn("next_us", F.lead("at_us").over(next_one)).withColumn(
        "next_slice", F.when(F.col("next_us").isNotNull(), F.col("slice"))
    )
    if plan.has_hot_servers:
        rows = _continue_in_later_slices(rows, same)
    # an older copy of the same instant has an empty interval
    rows = rows.filter(F.col("next_us").isNull() | (F.col("next_us") > F.col("at_us"))).select(
        "sn", "slice", "n_slices", "at_us", "ord", "time_ts", "msg", "server_model",
        "next_us", F.coalesce("next_slice", F.col("n_slices") - 1).alias("next_slice"),
    )
    # the cap reads sliced versions twice, for the carried ends and for the scan
    return materialize(rows) if plan.has_hot_servers else rows


def _continue_in_later_slices(rows: DataFrame, same: str) -> DataFrame:
    """For the last occurrence within a slice, the first one in a later slice."""
    firsts = (
        rows.filter("n_slices > 1")
        .groupBy("sn", same, "slice")
        .agg(F.min("at_us").alias("first_us"))
    )
    later = Window.partitionBy("sn", same).orderBy("slice")
    follow = firsts.select(
        "sn", same, "slice",
        F.lead("first_us").over(later).alias("later_us"),
        F.lead("slice").over(later).alias("later_slice"),
    ).filter("later_us is not null")
    return rows.join(follow, ["sn", same, "slice"], "left").withColumns(
        {
            "next_us": F.coalesce("next_us", "later_us"),
            "next_slice": F.coalesce("next_slice", "later_slice"),
        }
    )


# --- the oldest n, as intervals -------------------------------------------------

def cap_versions(
    versions: DataFrame, n: int = MAX_MESSAGES, plan: SlicePlan = WHOLE
) -> DataFrame:
    """Narrow each version to ``[cap_us, next_us)``, the time in which it is one
    of the ``n`` oldest of its server; versions that never are disappear.

    A version is among the oldest ``n`` as soon as fewer than ``n`` older ones
    are open, that is from the n-th largest end of the older ones. A heap of
    ``n`` ends per server is all the state this needs.
    """
    # behind n older versions that never end there is no room: such rows, nearly all
    # of a long history, neither enter nor change the heap and need not reach Python
    older = (
        Window.partitionBy(*plan.keys).orderBy("at_us", "ord")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    endless = F.coalesce(F.sum(F.col("next_us").isNull().cast("int")).over(older), F.lit(0))
    rows = (
        versions.withColumn("_endless", endless).filter(F.col("_endless") < n)
        .drop("_endless").withColumn("carried", F.lit(False))
    )
    if plan.has_hot_servers:
        rows = rows.unionByName(_carried_ends(versions, n), allowMissingColumns=True)
    if plan.has_hot_servers or _windows_move_rows(rows):
        rows = rows.repartition(*plan.keys)
    ordered = rows.sortWithinPartitions(
        "sn", "slice", F.col("carried").desc(), "at_us", "ord"
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields]
    schema = ", ".join([*fields, "cap_us bigint", "cap_slice int"])
    return (
        ordered.mapInArrow(_cap_starts(n), schema)
        .filter(~F.col("carried") & (F.col("cap_us") < F.coalesce("next_us", F.lit(_NEVER))))
        .drop("carried")
    )


def _windows_move_rows(df: DataFrame) -> bool:
    """Whether a window partitioned by more columns than the exchange below it
    is given an exchange of its own, which would part the rows of a server."""
    return (
        df.sparkSession.conf.get("spark.sql.requireAllClusterKeysForDistribution", "false")
        == "true"
    )


def _cap_starts(n: int):
    """Scan rows ordered by (sn, slice, time); add where each enters the cap."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ends = None, []
        for batch in batches:
            column = lambda name: batch.column(name).to_pylist()
            starts, slices = [], []
            for sn, part, at, end, end_slice in zip(
                column("sn"), column("slice"), column("at_us"),
                column("next_us"), column("next_slice"),
            ):
                if (sn, part) != group:
                    group, ends = (sn, part), []
                end = (_NEVER if end is None else end, end_slice)
                if len(ends) < n:
                    starts.append(at)
                    slices.append(part)
                    heapq.heappush(ends, end)
                else:
                    free_at, free_slice = ends[0]
                    late = at is not None and free_at > at
                    starts.append(free_at if late else at)
                    slices.append(free_slice if late else part)
                    heapq.heappushpop(ends, end)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(starts, pa.int64()), pa.array(slices, pa.int32())],
                names=[*batch.schema.names, "cap_us", "cap_slice"],
            )

    return scan


def _carried_ends(versions: DataFrame, n: int) -> DataFrame:
    """For each slice of a hot server the ``n`` largest ends of all earlier
    slices: at most ``n`` rows per slice, scanned in slice order."""
    largest = Window.partitionBy("sn", "slice").orderBy(F.col("next_us").desc_nulls_first())
    tops = (
        versions.filter("n_slices > 1")
        .select("sn", "slice", "next_us", "next_slice",
                F.row_number().over(largest).alias("rank"))
        .filter(F.col("rank") <= n)
        .drop("rank")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        server, part, ends = None, None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["sn"] != server:
                    server, part, ends = row["sn"], row["slice"], []
                elif row["slice"] != part:
                    part = row["slice"]
                    out.extend(
                        {"sn": server, "slice": part, "next_us": end, "next_slice": end_slice}
                        for end, end_slice in ends
                    )
                end = _NEVER if row["next_us"] is None else row["next_us"]
                push = heapq.heappush if len(ends) < n else heapq.heappushpop
                push(ends, (end, row["next_slice"]))
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    ordered = tops.repartition("sn").sortWithinPartitions("sn", "slice")
    return ordered.mapInArrow(
        scan, "sn string, slice int, next_us bigint, next_slice int"
    ).withColumn("carried", F.lit(True))


# --- faults meet intervals -------------------------------------------------------

def _fault_cells(points: DataFrame, plan: SlicePlan) -> tuple[DataFrame, DataFrame]:
    """Cut the faults of a unit, in time order, into cells of about
    ``FAULTS_PER_CELL``; equal instants share a cell. Returns the faults with
    their ``cell`` and, per unit, the cells with the instant each starts at."""
    place = F.rank().over(Window.partitionBy(*plan.keys).orderBy("fault_us"))
    celled = points.withColumn(
        "cell", F.floor((place - 1) / F.lit(FAULTS_PER_CELL)).cast("int")
    )
    starts = (
        celled.groupBy(*plan.keys, "cell").agg(F.min("fault_us").alias("from_us"))
        .groupBy(*plan.keys)
        .agg(F.array_sort(F.collect_list(F.struct("from_us", "cell"))).alias("cells"))
    )
    return celled, starts


def join_versions(
    faults: DataFrame,
    versions: DataFrame,
    plan: SlicePlan = WHOLE,
    start: str = "at_us",
    start_slice: str = "slice",
    keep: list[str | Column] | None = None,
) -> DataFrame:
    """Each fault with the versions whose interval ``[start, next_us)`` holds it.

    The join is on the server and a cell of neighbouring faults. A version is
    offered to the cells that its interval meets and to no others: to those it
    covers, where it matches every fault, and to the two at its borders. So the
    work is in proportion to versions, faults and matches. Where the plan has seen
    that no server has more faults than a cell, each server is one cell.
    """
    points = plan.assign(fault_points(faults)).drop("n_slices").withColumnRenamed("at_us", "fault_us")
    spans = versions
    if plan.has_hot_servers:
        spans = versions.withColumn(
            "slice", F.explode(F.sequence(F.col(start_slice), F.col("next_slice")))
        )
    if plan.most_faults is not None and plan.most_faults <= FAULTS_PER_CELL:
        points, spans = points.withColumn("cell", F.lit(0)), spans.withColumn("cell", F.lit(0))
    else:
        points, spans = _celled(points, spans, plan, start)
    points, spans = points.alias("f"), spans.alias("v")
    holds = (
        (F.col("f.sn") == F.col("v.sn"))
        & (F.col("f.slice") == F.col("v.slice"))
        & (F.col("f.cell") == F.col("v.cell"))
        & (F.col(f"v.{start}") <= F.col("f.fault_us"))
        & (F.col("f.fault_us") < F.coalesce("v.next_us", F.lit(_NEVER)))
    )
    keep = keep or ["at_us", "ord", "time_ts", "msg", "server_model"]
    picked = [F.col(f"v.{c}") if isinstance(c, str) else c for c in keep]
    return points.join(spans, holds).select(*[f"f.{c}" for c in SLICED_FAULT_KEY], *picked)


def _celled(points: DataFrame, spans: DataFrame, plan: SlicePlan, start: str) -> tuple[DataFrame, DataFrame]:
    """Faults with their cell, and each interval once for every cell it meets."""
    points, starts = _fault_cells(points, plan)
    end = F.coalesce(F.col("next_us"), F.lit(_NEVER))
    spans = spans.join(starts, plan.keys).withColumns({
        "_first": F.greatest(
            F.size(F.filter("cells", lambda c: c.from_us <= F.col(start))), F.lit(1)
        ),
        "_last": F.size(F.filter("cells", lambda c: c.from_us < end)),
    })
    met = F.slice("cells", F.col("_first"),
                  F.greatest(F.col("_last") - F.col("_first") + 1, F.lit(0)))
    return points, spans.withColumn("cell", F.explode(F.transform(met, lambda c: c.cell)))


def first_messages(
    faults: DataFrame,
    logs: DataFrame,
    n: int = MAX_MESSAGES,
    plan: SlicePlan = WHOLE,
    strip_before_dedup: bool = True,
    keep: list[str | Column] | None = None,
) -> DataFrame:
    """The oldest ``n`` deduplicated messages of each fault, at most ``n`` rows
    per fault; with :func:`earliest_rank` they can be numbered."""
    capped = cap_versions(message_versions(logs, plan, strip_before_dedup), n, plan)
    return join_versions(faults, capped, plan, "cap_us", "cap_slice", keep)


def earliest_rank() -> Column:
    """1-based position of a message within its fault, oldest first."""
    return F.row_number().over(Window.partitionBy(*SLICED_FAULT_KEY).orderBy("at_us", "ord"))


def dedup_totals(faults: DataFrame, logs: DataFrame, plan: SlicePlan = WHOLE,
                 strip_before_dedup: bool = True) -> DataFrame:
    """Size of each fault's deduplicated history, as births minus deaths."""
    versions = message_versions(logs, plan, strip_before_dedup)
    sizes = {
        "message_cnt": F.lit(1),
        "char_sum": fx.char_count(F.col("msg")),
        "word_sum": fx.word_count(F.col("msg")),
        "time_ts_sum": F.col("time_ts"),
    }
    births = versions.select("sn", "at_us", *[c.alias(m) for m, c in sizes.items()])
    deaths = versions.filter("next_us is not null").select(
        "sn", F.col("next_us").alias("at_us"), *[(-c).alias(m) for m, c in sizes.items()]
    )
    totals = running_totals(faults, births.unionByName(deaths), list(sizes), plan)
    return totals.filter("message_cnt > 0").drop("at_us")


def distinct_faults(faults: DataFrame) -> DataFrame:
    """Training rows unique on server, time and label; conflicting labels stay."""
    return faults.dropDuplicates(["sn", "fault_time", "label"])
