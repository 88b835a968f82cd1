import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultloom.operators import folds as fd
from faultloom.operators import scaling
from faultloom.operators import scores as sc
from faultloom.operators.ranking import split_row_number


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, 0 if rng.random() < 0.5 else rng.randrange(4)) for i in range(503)]
    return spark.createDataFrame(data, "row_id long, label int")


def test_split_row_number_equals_the_plain_one(spark, rows):
    bucket = F.floor(F.col("row_id") / 7)
    got = split_row_number(rows, ["label"], bucket, [F.col("row_id")], "n").collect()
    seen = Counter()
    for r in sorted(got, key=lambda r: r["row_id"]):
        seen[r["label"]] += 1
        assert r["n"] == seen[r["label"]]


def test_stratified_folds_are_balanced_and_cover_all_rows(rows):
    got = fd.stratified_folds(rows, digits=1).collect()
    assert sorted(r["row_id"] for r in got) == list(range(503))
    for label in range(4):
        sizes = Counter(r["fold"] for r in got if r["label"] == label)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5


def test_folds_depend_on_key_and_seed_only(rows):
    key = lambda df: {r["row_id"]: r["fold"] for r in df.collect()}
    first = key(fd.stratified_folds(rows))
    assert first == key(fd.stratified_folds(rows.repartition(7)))
    assert first != key(fd.stratified_folds(rows, seed=1))


def test_rows_without_a_label_keep_a_fold(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "row_id long, label int")
    assert fd.stratified_folds(df).count() == 2


def test_plain_folds(rows):
    sizes = Counter(r["fold"] for r in fd.plain_folds(rows).collect())
    assert sorted(sizes.values()) == [100, 100, 101, 101, 101]


def test_holdout_is_exact_per_class(rows):
    got = fd.stratified_holdout(rows).collect()
    for label in range(4):
        own = [r["is_validation"] for r in got if r["label"] == label]
        assert sum(own) == round(len(own) * 0.25)


def test_fold_parts(rows):
    folds = fd.stratified_folds(rows)
    assert fd.training_rows(folds, 2).count() + fd.validation_rows(folds, 2).count() == 503


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (2,)], "label int")
    got = {r["label"]: r["weight"] for r in fd.balanced_class_weights(df).collect()}
    assert got == pytest.approx({0: 4 / (2 * 3), 2: 4 / 2})
    mapped = fd.map_class_weight(df, fd.balanced_class_weights(df))
    assert mapped.agg(F.sum("weight")).first()[0] == pytest.approx(4)


# --- metrics ---------------------------------------------------------------------------------

def plain_f1(target, pred, weights=sc.CLASS_WEIGHTS):
    score = 0.0
    for c, w in enumerate(weights):
        tp = sum(t == c and p == c for t, p in zip(target, pred))
        fp = sum(t != c and p == c for t, p in zip(target, pred))
        fn = sum(t == c and p != c for t, p in zip(target, pred))
        score += w * (2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return score


@pytest.mark.parametrize("classes", [4, 3, 6])
def test_weighted_macro_f1(spark, classes):
    rng = random.Random(classes)
    data = [(rng.randrange(classes), rng.randrange(classes)) for _ in range(200)]
    df = spark.createDataFrame(data, "target int, predict int")
    got = sc.weighted_macro_f1(df).first()["macro_f1"]
    assert got == pytest.approx(plain_f1(*zip(*data)))


def test_absent_class_scores_zero_and_unknown_targets_are_errors(spark):
    df = spark.createDataFrame([(0, 0), (None, 0), (-1, 1)], "target int, predict int")
    counts = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in sc.confusion_counts(df).collect()}
    assert counts == {0: (1, 1, 0), 1: (0, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0)}
    assert sc.weighted_macro_f1(df).first()[0] == pytest.approx(5 / 11 * 2 / 3)


def test_fold_scores_and_summary(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(4), i % 3, [rng.random() for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(data, "row_id int, target int, fold int, prob array<double>")
    scores = sc.fold_scores(df, {"m": "prob"})
    got = {r["fold"]: r["macro_f1"] for r in scores.collect()}
    pred = [max(range(4), key=lambda c: p[c]) for _, _, _, p in data]
    expected = {None: plain_f1([d[1] for d in data], pred)}
    for f in range(3):
        pick = [i for i, d in enumerate(data) if d[2] == f]
        expected[f] = plain_f1([data[i][1] for i in pick], [pred[i] for i in pick])
    assert got == pytest.approx(expected)
    row = sc.fold_score_summary(scores).first()
    per_fold = [expected[f] for f in range(3)]
    mean = sum(per_fold) / 3
    assert row["folds"] == 3 and row["mean_score"] == pytest.approx(mean)
    assert row["std_score"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in per_fold) / 3))
    assert row["oof_score"] == pytest.approx(expected[None])


def test_fold_average_and_sum(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])], "row_id int, prob array<double>")
    assert sc.fold_average(df).first()["prob"] == [0.5, 0.5, 0, 0]
    assert sc.fold_average(df, how="sum").first()["prob"] == [1, 1, 0, 0]


def focal(x, t, alpha=0.75, gamma=2.0):
    p = 1 / (1 + math.exp(-x))
    pt = p if t else 1 - p
    return -(alpha if t else 1 - alpha) * (1 - pt) ** gamma * math.log(pt)


def focal_derivatives(x, t, alpha=0.75):
    """Exact first and second derivative for gamma = 2."""
    a, s = (alpha, 1) if t else (1 - alpha, -1)
    p = 1 / (1 + math.exp(-s * x))
    q = 1 - p
    first = a * (2 * q * q * p * math.log(p) - q**3)
    second = a * p * q * (-4 * q * p * math.log(p) + 2 * q * q * math.log(p) + 2 * q * q + 3 * q * q)
    return s * first, second


def test_focal_loss_and_its_derivatives(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(4), [rng.uniform(-3, 3) for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(data, "row_id int, target int, logits array<double>")
    cells = [focal(x, t == c) for _, t, xs in data for c, x in enumerate(xs)]
    assert sc.focal_loss(df).first()[0] == pytest.approx(sum(cells) / len(cells))
    got = {(r["row_id"], r["class"]): r for r in sc.focal_gradient(df).collect()}
    assert len(got) == 120
    for i, t, xs in data:
        for c, x in enumerate(xs):
            first, second = focal_derivatives(x, t == c)
            assert got[(i, c)]["grad"] == pytest.approx(first, abs=1e-6)
            assert got[(i, c)]["hess"] == pytest.approx(second, abs=5e-3)


def test_softmax_log_loss(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 0.0])], "target int, logits array<double>")
    assert sc.softmax_log_loss(df).first()[0] == pytest.approx(math.log(4))


def test_confidence_gate(spark):
    data = [(1, [0.8, 0.2, 0.0, 0.0]), (2, [0.79, 0.21, 0.0, 0.0]), (3, [0.0, 0.9, 0.1, 0.0]),
            (4, [0.0, 0.01, 0.99, 0.0]), (5, [0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(data, "row_id int, prob array<double>")
    kept = {r["row_id"]: r["label"] for r in sc.confident_rows(df).collect()}
    assert kept == {1: 0, 3: 1}
    assert sc.without_pseudo(df, sc.confident_rows(df), ["row_id"]).count() == 3


def test_append_pseudo_marks_the_origin(spark):
    real = spark.createDataFrame([(1, 0)], "row_id int, label int")
    got = sc.append_pseudo(real, real).collect()
    assert sorted(r["is_real"] for r in got) == [0, 1]


@pytest.mark.parametrize("width", [3, 1_000_000])
def test_moving_average_is_the_recurrence(spark, width):
    rng = random.Random(2)
    series = {k: [rng.uniform(0, 9) for _ in range(n)] for k, n in (("a", 1), ("b", 40), ("c", 300))}
    order = [(k, v) for k, vs in series.items() for v in vs]
    df = spark.createDataFrame(
        [(k, i, v) for i, (k, v) in enumerate(order)], "k string, pos long, value double")
    got = {
        r["k"]: (r["steps"], r["ema"])
        for r in sc.final_ema(sc.with_steps(df, ["k"], "pos", width), ["k"]).collect()
    }
    for k, vs in series.items():
        ema = 0.0
        for v in vs:
            ema = 0.9 * ema + 0.1 * v
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(ema)


def test_min_max_scaling_of_a_constant_and_of_new_values(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    model = scaling.fit_min_max(df, "v")
    out = [r["s"] for r in df.select(model.transform(F.col("v")).alias("s")).collect()]
    assert sorted(out) == [[0.0, 0.0], [1.0, 0.0]]
    new = spark.createDataFrame([([5.0, 6.0],)], "v array<double>")
    assert new.select(model.transform(F.col("v"))).first()[0] == [2.0, 1.0]


def test_losses_keep_extreme_logits(spark):
    df = spark.createDataFrame(
        [(1, 0, [0.0, 800.0, 0.0, 0.0]), (2, 1, [0.0, 0.0, 0.0, 0.0]), (3, 2, [40.0, -1000.0, 1000.0, 5.0])],
        "row_id int, target int, logits array<double>")
    log_loss = sc.softmax_log_loss(df).first()[0]
    assert log_loss == pytest.approx((800 + math.log(4) + 0) / 3)
    cells = sc.focal_gradient(df).collect()
    assert len(cells) == 12 and all(math.isfinite(r["grad"]) and math.isfinite(r["hess"]) for r in cells)
    # a miss by 800 costs about its size: weight 0.25 for a wrong class
    assert sc.focal_loss(df.filter("row_id = 1")).first()[0] == pytest.approx(
        (0.25 * 800 + 0.75 * 0.25 * math.log(2) + 2 * 0.25 * 0.25 * math.log(2)) / 4)
