import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from faultloom.functions import columns as fx
from faultloom.functions.stop_words import ENGLISH_STOP_WORDS


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_parse_is_strict_or_tolerant(spark):
    df = spark.createDataFrame([("2024-02-30 00:00:00",)], ["t"])
    with pytest.raises(PySparkException):
        df.select(fx.parse_timestamp(F.col("t"))).collect()
    assert df.select(fx.parse_timestamp(F.col("t"), tolerant=True)).first()[0] is None
    good = fx.parse_timestamp(F.lit("2024-02-29 23:59:58"))
    assert str(one(spark, good)) == "2024-02-29 23:59:58"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_epoch_ignores_the_session_zone(spark, zone):
    # the clock of New York skips this hour
    t = F.expr("timestamp_ntz'2024-03-10 02:30:00.250001'")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, fx.epoch_seconds(t)) == 1710037800
        assert one(spark, fx.epoch_micros(t)) == 1710037800250001
        before = F.expr("timestamp_ntz'1969-12-31 23:59:59.5'")
        assert one(spark, fx.epoch_micros(before)) == -500000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "msg, token, cat, words, chars",
    [
        ("Memory #0x1  a", "Memory", 0, 4, 14),
        ("", "", 34, 1, 0),
        ("a  b ", "a", 34, 4, 5),
        (" \tDrive x", "Drive", 4, 2, 9),
        ("Slot/Connector", "Slot/Connector", 12, 1, 14),
        ("memory", "memory", 34, 1, 6),
        ("Fan\U0001f300", "Fan\U0001f300", 34, 1, 4),
        ("   ", "", 34, 4, 3),
    ],
)
def test_message_scalars(spark, msg, token, cat, words, chars):
    m = F.col("m")
    assert one(spark, fx.category_token(m), m=msg) == token
    assert one(spark, fx.category_id(m), m=msg) == cat
    assert one(spark, fx.word_count(m), m=msg) == words
    assert one(spark, fx.char_count(m), m=msg) == chars


def test_strip_delimiter_leaves_blanks(spark):
    assert one(spark, fx.strip_delimiter(F.col("m")), m="a | b|") == "a  b"


def test_fault_id(spark):
    c = fx.fault_id(F.lit("S1"), F.lit(17), F.lit(-1))
    assert one(spark, c) == "S117-1"


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_softmax_sums_to_one_even_for_large_logits(spark):
    p = one(spark, fx.softmax(arr(1000, 1000, 0, -1000)))
    assert p[0] == p[1] == 0.5 and math.isclose(sum(p), 1)


def test_sigmoid_and_one_hot(spark):
    assert one(spark, fx.sigmoid(arr(0, 100)))[0] == 0.5
    assert one(spark, fx.one_hot(F.lit(2))) == [0, 0, 1, 0]
    assert one(spark, fx.one_hot(F.lit(-1))) == [0, 0, 0, 0]


def test_argmax_takes_the_first_maximum(spark):
    assert one(spark, fx.argmax(arr(0.2, 0.4, 0.4, 0))) == 1


def test_round_half_even(spark):
    assert [one(spark, fx.round_half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, fx.round_half_even(F.lit(0.12345), 4)) == 0.1234


def test_vote_is_the_rounded_mean_of_class_ids(spark):
    zero, three = arr(1, 0, 0, 0), arr(0, 0, 0, 1)
    assert one(spark, fx.ordinal_vote([zero, zero, three])) == 1.0


def test_blends(spark):
    a, b = arr(1, 0, 0, 0), arr(0, 1, 0, 0)
    assert one(spark, fx.blend([a, b], [0.25, 0.75])) == [0.25, 0.75, 0, 0]
    assert one(spark, fx.blend_mean([a, b])) == [0.5, 0.5, 0, 0]
    with pytest.raises(ValueError):
        fx.blend([a, b], [1.0])


def test_stop_words_are_the_ones_that_can_match(spark):
    from pyspark.ml.feature import StopWordsRemover

    listed = StopWordsRemover.loadDefaultStopWords("english")
    assert sorted(ENGLISH_STOP_WORDS) == sorted(w for w in listed if "'" not in w)
