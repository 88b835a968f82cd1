import pytest
from pyspark.errors import PySparkException

from faultloom.functions.columns import UNLABELLED
from faultloom.sources import readers, writers

from helpers import fault_table, log_table, ts


def write(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


@pytest.fixture
def faults_csv(tmp_path):
    a = write(tmp_path / "a.csv", "sn,fault_time,label\nS2,2024-01-01 00:00:05,1\nS1,2024-01-01 00:00:09,0\n")
    b = write(tmp_path / "b.csv", "label,sn,fault_time,note\n3,S1,2024-01-01 00:00:01,hi\n")
    return [a, b]


def test_faults_are_matched_by_header_name(spark, faults_csv):
    got = readers.sort_faults(readers.read_faults(spark, faults_csv)).collect()
    assert [(r["sn"], r["fault_time_ts"], r["label"], r["note"]) for r in got] == [
        ("S1", ts(1), 3, "hi"), ("S1", ts(9), 0, None), ("S2", ts(5), 1, None)]


def test_one_path_and_unlabelled(spark, faults_csv):
    got = readers.read_faults(spark, faults_csv[0], training=False)
    assert {r["label"] for r in got.collect()} == {UNLABELLED}


def test_missing_label_column(spark, tmp_path):
    path = write(tmp_path / "s.csv", "sn,fault_time\nS1,2024-01-01 00:00:01\n")
    assert readers.read_faults(spark, path).first()["label"] is None
    assert readers.read_faults(spark, path, training=False).first()["label"] == -1


def test_other_arguments_give_an_empty_table(spark):
    assert readers.read_faults(spark, None).count() == 0
    assert "time_ts" in readers.read_logs(spark, ("a.csv",)).columns


def test_bad_time_fails_or_is_null(spark, tmp_path):
    path = write(tmp_path / "f.csv", "sn,fault_time,label\nS1,01.02.2024,0\n")
    with pytest.raises(PySparkException):
        readers.read_faults(spark, path).collect()
    row = readers.read_faults(spark, path, tolerant=True).first()
    assert row["fault_time"] is None and row["fault_time_ts"] is None


def test_logs_keep_file_order_in_ord(spark, tmp_path):
    a = write(tmp_path / "a.csv", "sn,time,msg,server_model\n"
              'S1,2024-01-01 00:00:05,"Memory, ""x"" | y",A\nS1,2024-01-01 00:00:05,second,A\n')
    b = write(tmp_path / "b.csv", "sn,time,msg,server_model\nS1,2024-01-01 00:00:05,third,\n")
    got = readers.sort_logs(readers.read_logs(spark, [a, b])).collect()
    assert [r["msg"] for r in got] == ['Memory, "x" | y', "second", "third"]
    assert got[2]["server_model"] is None and got[0]["time_ts"] == ts(5)


def test_crashdump_and_venus(spark, tmp_path):
    crash = write(tmp_path / "c.csv", "sn,fault_time,fault_code\nS1,2024-01-01 00:00:05,E1.E2\n")
    venus = write(tmp_path / "v.csv", "sn,fault_time,module_cause,module\nS1,2024-01-01 00:00:05,m,n\n")
    assert readers.read_crashdump(spark, crash).first()["fault_code"] == "E1.E2"
    row = readers.read_venus(spark, [venus]).first()
    assert (row["module_cause"], row["module"], str(row["fault_time"])) == ("m", "n", "2024-01-01 00:00:05")


def test_predictions_and_features_round_trip(spark, tmp_path):
    ft = fault_table(spark, [("S1", 5, 2)])
    writers.write_predictions(ft, str(tmp_path / "p"))
    back = readers.read_faults(spark, str(tmp_path / "p")).first()
    assert (back["sn"], back["fault_time_ts"], back["label"]) == ("S1", ts(5), 2)
    lt = log_table(spark, [("S1", 1, 'say "hi", | bye', "A")])
    writers.write_features(lt, str(tmp_path / "f"))
    assert readers.read_features(spark, str(tmp_path / "f"), ["msg"], "ord", ["sn"]).first()[1] == 'say "hi", | bye'
    writers.write_features(lt, str(tmp_path / "c"), "csv")
    assert readers.read_logs(spark, str(tmp_path / "c")).first()["msg"] == 'say "hi", | bye'


def test_vectors_spread_over_columns(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.dense(0.5, 0.25))], ["i", "tfidf"])
    row = writers.spread_vectors(df, 3).first()
    assert row.asDict() == {"i": 1, "tfidf_0": 0.5, "tfidf_1": 0.25, "tfidf_2": None}


def test_positions_follow_the_files(spark, tmp_path):
    head = "sn,time,msg,server_model\n"
    line = lambda f, i: f"S1,2024-01-01 00:00:00,{f}{i:05d},A\n"
    folder = tmp_path / "logs"
    folder.mkdir()
    write(folder / "a.csv", head + line("a", 0))
    write(folder / "b.csv", head + "".join(line("b", i) for i in range(3000)))
    last = write(tmp_path / "0.csv", head + "".join(line("c", i) for i in range(5)))
    want = ["a00000"] + [f"b{i:05d}" for i in range(3000)] + [f"c{i:05d}" for i in range(5)]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in (before, "16k"):
            spark.conf.set(key, size)
            rows = readers.read_logs(spark, [str(folder), last])
            assert [r["msg"] for r in rows.orderBy("ord").collect()] == want
    finally:
        spark.conf.set(key, before)
    assert readers.read_logs(spark, []).count() == 0


def test_line_breaks_in_messages(spark, tmp_path):
    path = write(tmp_path / "l.csv", 'sn,time,msg,server_model\nS1,2024-01-01 00:00:00,"line1\nline2",A\n')
    rows = readers.read_logs(spark, path, multiline=True).collect()
    assert [(r["msg"], r["server_model"]) for r in rows] == [("line1\nline2", "A")]
