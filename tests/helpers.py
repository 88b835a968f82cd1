"""Small tables and a plain-Python account of what the operators must return."""

from collections import Counter
from datetime import datetime, timedelta

from faultloom.functions.categories import CATEGORY_IDS, UNKNOWN_CATEGORY

SMALL = "/root/testdata/sf0.001"

T0 = datetime(2024, 1, 1)
FAULT_SCHEMA = "sn string, fault_time timestamp_ntz, label int, fault_time_ts bigint"
LOG_SCHEMA = (
    "sn string, time timestamp_ntz, msg string, server_model string, time_ts bigint, ord bigint"
)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def ts(seconds):
    return int((at(seconds) - datetime(1970, 1, 1)).total_seconds())


def fault_table(spark, rows):
    """rows: (sn, second, label)"""
    return spark.createDataFrame([(s, at(t), lab, ts(t)) for s, t, lab in rows], FAULT_SCHEMA)


def log_table(spark, rows):
    """rows: (sn, second, msg, server_model); the order decides ties"""
    data = [(s, at(t), m, sm, ts(t), i) for i, (s, t, m, sm) in enumerate(rows)]
    return spark.createDataFrame(data, LOG_SCHEMA)


def history(faults, logs, strip_first=True):
    """fault -> its deduplicated history [(second, ord, msg, server_model)], oldest first"""
    result = {}
    for sn, when, label in set(faults):
        latest = {}
        for i, (s, t, msg, sm) in enumerate(logs):
            if s == sn and t <= when:
                key = msg.replace("|", "") if strip_first else msg
                row = (t, i, msg.replace("|", ""), sm)
                if key not in latest or latest[key][:2] < row[:2]:
                    latest[key] = row
        if latest:
            result[(sn, ts(when), label)] = sorted(latest.values())
    return result


def category(msg):
    return CATEGORY_IDS.get(msg.strip().split(" ")[0], UNKNOWN_CATEGORY)


def mode(values):
    counts = Counter(values)
    return min(counts, key=lambda v: (-counts[v], v))


def keyed(df, columns):
    """rows by fault key"""
    return {
        (r["sn"], r["fault_time_ts"], r["label"]): tuple(r[c] for c in columns)
        for r in df.collect()
    }
