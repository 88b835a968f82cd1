import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultloom.operators import history as hs
from faultloom.operators import log_features as lf
from faultloom.operators.slices import WHOLE, plan_slices

from helpers import category, fault_table, history, keyed, log_table, mode, ts

MINUTE_CUTS = dict(rows_per_slice=12, cell_us=60_000_000)


def skewed_rows(seed, hot_share=0.5, n_logs=400, n_faults=120, messages=25):
    """One server holds the given share of all rows; instants repeat."""
    rng = random.Random(seed)
    server = lambda: "hot" if rng.random() < hot_share else f"s{rng.randrange(6)}"
    heads = ["Memory", "Drive", "Gizmo", "System", "Slot/Connector"]
    logs = [
        (server(), rng.randrange(4000), f"{rng.choice(heads)} #{rng.randrange(messages)} | x",
         rng.choice(["A", "B", None]))
        for _ in range(n_logs)
    ]
    faults = [(server(), rng.randrange(4000), rng.randrange(4)) for _ in range(n_faults)]
    return faults, logs


@pytest.fixture(scope="module", params=["whole", "sliced"])
def skewed(request, spark):
    faults, logs = skewed_rows(7)
    ft, lt = fault_table(spark, faults), log_table(spark, logs)
    options = MINUTE_CUTS if request.param == "sliced" else {}
    plan = hs.slice_plan(ft, lt, **options)
    assert plan.has_hot_servers == (request.param == "sliced")
    return faults, logs, ft, lt, plan


def test_history_is_every_log_up_to_and_including_the_fault(skewed):
    faults, logs, ft, lt, plan = skewed
    expected = {}
    for sn, when, label in set(faults):
        n = sum(1 for s, t, _, _ in logs if s == sn and t <= when)
        if n:
            expected[(sn, ts(when), label)] = (n,)
    assert keyed(hs.fault_history(ft, lt, plan), ["history_cnt"]) == expected


def test_pairs_written_out_agree_with_the_prefix_form(skewed):
    _, _, ft, lt, plan = skewed
    pairs = hs.history_pairs(ft, lt).groupBy("sn", "fault_time_ts", "label").count()
    assert keyed(pairs, ["count"]) == keyed(hs.fault_history(ft, lt, plan), ["history_cnt"])


@pytest.mark.parametrize("strip_first", [True, False])
def test_dedup_keeps_the_latest_of_each_message(skewed, strip_first):
    faults, logs, ft, lt, plan = skewed
    expected = {
        key: (len(rows), sum(ts(t) for t, _, _, _ in rows))
        for key, rows in history(faults, logs, strip_first).items()
    }
    got = hs.dedup_totals(ft, lt, plan, strip_first)
    assert keyed(got, ["message_cnt", "time_ts_sum"]) == expected


@pytest.mark.parametrize("n", [1, 3, 40])
def test_oldest_messages(skewed, n):
    faults, logs, ft, lt, plan = skewed
    got = {}
    for r in hs.first_messages(ft, lt, n, plan).collect():
        got.setdefault((r["sn"], r["fault_time_ts"], r["label"]), []).append((r["ord"], r["msg"]))
    expected = {
        key: sorted((o, m) for _, o, m, _ in rows[:n])
        for key, rows in history(faults, logs).items()
    }
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_merged_text_is_whole_and_in_time_order(skewed):
    faults, logs, ft, lt, plan = skewed
    expected = {
        key: ("。".join(m for _, _, m, _ in rows),) for key, rows in history(faults, logs).items()
    }
    assert keyed(lf.merged_messages(ft, lt, plan), ["msg"]) == expected


def test_statistics_of_the_capped_history(skewed):
    faults, logs, ft, lt, plan = skewed
    expected = {}
    for key, rows in history(faults, logs).items():
        kept = [category(m) for _, _, m, _ in rows[:5]]
        last, top = kept[-1], mode(kept)
        expected[key] = (last, top, len(kept), kept.count(last) / len(kept),
                         kept.count(top) / len(kept), len(set(kept)))
    messages = lf.capped_messages(ft, lt, plan, max_messages=5)
    columns = ["last_category_id", "mode_category_id", "log_cnt", "last_category_occupy",
               "mode_category_occupy", "category_nunique"]
    assert keyed(lf.category_statistics(messages), columns) == expected


def test_slices_cut_hot_servers_only_and_lose_no_row(spark):
    faults, logs = skewed_rows(3)
    ft, lt = fault_table(spark, faults), log_table(spark, logs)
    plan = hs.slice_plan(ft, lt, rows_per_slice=100, cell_us=60_000_000)
    rows = plan.assign(hs.log_points(lt)).collect()
    assert len(rows) == len(logs)
    hot = {r["slice"] for r in rows if r["sn"] == "hot"}
    assert len(hot) > 1 and {r["slice"] for r in rows if r["sn"] != "hot"} == {0}
    last = {}
    for r in sorted(rows, key=lambda r: (r["sn"], r["at_us"])):
        assert r["slice"] >= last.get(r["sn"], 0)  # slices follow time
        last[r["sn"]] = r["slice"]


def test_large_slice_table_is_joined_instead_of_broadcast(spark):
    faults, logs = skewed_rows(5)
    ft, lt = fault_table(spark, faults), log_table(spark, logs)
    instants = [hs.fault_points(ft), hs.log_points(lt)]
    small = plan_slices(instants, rows_per_slice=30, cell_us=60_000_000)
    joined = plan_slices(instants, rows_per_slice=30, cell_us=60_000_000, max_slices=10)
    assert small.small_lookup and not joined.small_lookup
    # the bound on the broadcast changes the join only, never the slices
    assert sorted(small.lookup.collect()) == sorted(joined.lookup.collect())
    a = keyed(hs.fault_history(ft, lt, small), ["history_cnt"])
    assert a == keyed(hs.fault_history(ft, lt, joined), ["history_cnt"])


def test_cells_of_few_faults_lose_no_match(skewed, monkeypatch):
    faults, logs, ft, lt, plan = skewed
    monkeypatch.setattr(hs, "FAULTS_PER_CELL", 3)
    got = {}
    for r in hs.first_messages(ft, lt, 5, plan).collect():
        got.setdefault((r["sn"], r["fault_time_ts"], r["label"]), []).append(r["ord"])
    expected = {k: sorted(o for _, o, _, _ in rows[:5]) for k, rows in history(faults, logs).items()}
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_copies_of_one_instant_do_not_pile_up(spark):
    """A third of all rows are copies of one message in one second."""
    logs = [("hot", 50, "Memory | again", "A")] * 200
    logs += [("hot", 10 * i, f"Drive {i % 7}", "A") for i in range(60)]
    faults = [("hot", 10 * i + 5, i % 4) for i in range(60)]
    ft, lt = fault_table(spark, faults), log_table(spark, logs)
    plan = hs.slice_plan(ft, lt, **MINUTE_CUTS)
    assert plan.has_hot_servers
    versions = hs.message_versions(lt, plan)
    assert versions.filter("msg = 'Memory  again'").count() == 1
    expected = {key: (len(rows),) for key, rows in history(faults, logs).items()}
    assert keyed(hs.dedup_totals(ft, lt, plan), ["message_cnt"]) == expected


def test_one_exchange_of_the_log_table(spark, small):
    """Window, cap and (unbroadcast) join share the partitioning by server."""
    faults, logs = skewed_rows(7)
    plan = hs.cap_versions(hs.message_versions(log_table(spark, logs)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_cap_survives_strict_key_distribution(spark):
    faults, logs = skewed_rows(11)
    ft, lt = fault_table(spark, faults), log_table(spark, logs)
    expected = {key: min(3, len(rows)) for key, rows in history(faults, logs).items()}
    strict = "spark.sql.requireAllClusterKeysForDistribution"
    spark.conf.set(strict, "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = hs.first_messages(ft, lt, 3).groupBy("sn", "fault_time_ts", "label").count()
        assert {k: v[0] for k, v in keyed(rows, ["count"]).items()} == expected
    finally:
        spark.conf.unset(strict)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- hand-made cases ------------------------------------------------------------------------

def test_inclusive_bound_and_no_history(spark):
    ft = fault_table(spark, [("a", 5, 0), ("a", 1, 0), ("b", 5, 1)])
    lt = log_table(spark, [("a", 5, "Memory x", "A"), ("b", 6, "Memory x", "A")])
    assert set(keyed(hs.fault_history(ft, lt), ["history_cnt"])) == {("a", ts(5), 0)}


def test_repeated_message_moves_to_its_latest_time(spark):
    ft = fault_table(spark, [("a", 9, 0)])
    lt = log_table(spark, [("a", 1, "Memory x", "A"), ("a", 5, "Memory x", "A")])
    (row,) = hs.first_messages(ft, lt).collect()
    assert row["time_ts"] == ts(5)


def test_delimiter_before_or_after_dedup(spark):
    ft = fault_table(spark, [("a", 9, 0)])
    lt = log_table(spark, [("a", 1, "a|b", "A"), ("a", 2, "ab", "A")])
    assert hs.first_messages(ft, lt).count() == 1
    assert hs.first_messages(ft, lt, strip_before_dedup=False).count() == 2


def test_cap_keeps_the_oldest_and_text_keeps_all(spark):
    ft = fault_table(spark, [("a", 99, 0)])
    logs = [("a", i, f"{'Drive' if i == 39 else 'Memory'} m{i}", "A") for i in range(45)]
    (row,) = lf.base_features_v2(ft, log_table(spark, logs)).collect()
    assert row["dup_log_cnt"] == 40
    assert row["last_category_id"] == 4  # of the 40th message
    assert row["msg"].count("。") == 44


def test_tie_on_time_and_mode_tie(spark):
    ft = fault_table(spark, [("a", 9, 0)])
    lt = log_table(spark, [
        ("a", 1, "Temperature 1", "A"), ("a", 2, "Temperature 2", "A"),
        ("a", 5, "System 1", "A"), ("a", 5, "System 2", "A"), ("a", 5, "Fan", "A"),
    ])
    (row,) = lf.category_statistics(lf.capped_messages(ft, lt)).collect()
    assert row["mode_category_id"] == 1  # 3, 3, 1, 1, 18: the smaller of the two
    assert row["last_category_id"] == 18  # the later row of equal times


def test_two_models_and_a_missing_one(spark):
    ft = fault_table(spark, [("a", 9, 0)])
    lt = log_table(spark, [
        ("a", 1, "Memory 1", None), ("a", 3, "Drive 1", "A"), ("a", 4, "Fan 1", "B"),
    ])
    rows = {r["server_model"]: r for r in lf.base_features_v2(ft, lt).collect()}
    assert set(rows) == {"A", "B"}
    assert {r["dup_log_cnt"] for r in rows.values()} == {3}
    assert {r["dup_max_time_gap"] for r in rows.values()} == {8}
    assert rows["A"]["tail_log_cnt"] == 1 and rows["A"]["tail_max_time_gap"] == 6
    assert rows["A"]["msg"] == "Memory 1。Drive 1。Fan 1"
    v1 = {r["server_model"]: r for r in lf.base_features_v1(ft, lt).collect()}
    assert v1["A"]["msg"] == "Drive 1" and v1["A"]["log_cnt"] == 3


def test_missing_history_can_be_kept(spark):
    ft = fault_table(spark, [("a", 5, 0), ("b", 5, 1)])
    lt = log_table(spark, [("a", 5, "Memory x", "A")])
    assert lf.base_features_v2(ft, lt).count() == 1
    kept = lf.base_features_v2(ft, lt, missing_history="keep").collect()
    assert {(r["sn"], r["dup_log_cnt"]) for r in kept} == {("a", 1), ("b", None)}


def test_null_server_message_and_time_are_left_out_and_counted(spark):
    ft = fault_table(spark, [("a", 5, 0)])
    lt = log_table(spark, [("a", 1, None, "A"), ("a", 2, "Memory", "A"), (None, 1, "x", "A")])
    lt = lt.unionByName(lt.filter("msg = 'Memory'").selectExpr(
        "sn", "cast(null as timestamp_ntz) as time", "'later' as msg", "server_model",
        "cast(null as bigint) as time_ts", "99L as ord"))
    assert keyed(hs.fault_history(ft, lt), ["history_cnt"]) == {("a", ts(5), 0): (1,)}
    report = lf.quality_report(lt).first()
    assert (report["rows"], report["null_msg"], report["null_sn"], report["null_time"]) == (4, 1, 1, 1)


def test_distinct_faults_keep_conflicting_labels(spark):
    ft = fault_table(spark, [("a", 5, 0), ("a", 5, 0), ("a", 5, 1)])
    assert hs.distinct_faults(ft).count() == 2


# --- property: any small table, whole and cut into slices -------------------------------------

_logs = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 600), st.sampled_from(["M", "M|", "D", "F"]),
              st.sampled_from(["A", "B"])), min_size=1, max_size=30)
_faults = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 600), st.integers(0, 3)), min_size=1, max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(faults=_faults, logs=_logs, n=st.integers(1, 3), cut=st.sampled_from([3, 1000]))
def test_oldest_messages_of_any_table(spark, faults, logs, n, cut):
    ft, lt = fault_table(spark, faults), log_table(spark, logs)
    plan = hs.slice_plan(ft, lt, rows_per_slice=cut, cell_us=60_000_000)
    got = {}
    for r in hs.first_messages(ft, lt, n, plan).collect():
        got.setdefault((r["sn"], r["fault_time_ts"], r["label"]), set()).add(r["ord"])
    assert got == {k: {o for _, o, _, _ in rows[:n]} for k, rows in history(faults, logs).items()}


def test_empty_tables(spark):
    ft, lt = fault_table(spark, []), log_table(spark, [])
    assert hs.slice_plan(ft, lt) == WHOLE
    assert lf.base_features_v2(ft, lt).count() == 0
