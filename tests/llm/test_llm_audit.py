"""Source divergence, Merkle manifest and source mixing against plain accounts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultloom.llm import divergence as dv
from faultloom.llm import manifest as mf
from faultloom.llm import mixing as mx
from faultloom.llm.oracles import DIVERGENCE, MANIFEST
from faultloom.llm.ordering import join_small, rank_within
from faultloom.llm.queries import LLM_ORACLES, LLM_QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); with columns whose names operators use inside"""
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    for name in ("rank", "size", "tree", "lo", "hi", "digest", "kids", "path", "root", "spread", "n", "p", "u",
                 "class", "term", "m", "f", "target", "taken", "whole", "extra", "_at", "bucket", "level"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def odd_rows():
    rng = random.Random(3)
    words = "the of a Étude été ÉTUDE over x1y z- naïve 日本 the the OF".split()
    rows = [(None, None, None, None), (None, "", "en", ""), (None, None, None, None), (7, "Same Text", "en", "s0"),
            (7, "Same Text", "en", "s0"), (7, "Other Text", "en", "s0"), (8, "Lone", "de", "lone"), (9, None, "fr", "s1"),
            (10, "1234 -- \x00", "xx", "empty"), (11, "42", "xx", "void"), (-5, "neg THE of", "en", "s1"),
            (12, "the " * 30000, "en", "s2"), (2 ** 62, "Big id The", "en", "é")]
    for i in range(300):
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "é", "a", "Z", None, ""])
        lang = rng.choice(["en", "en", "de", None, "fr"])
        rows.append((100 + i, " ".join(rng.choice(words) + rng.choice(["", "", "q", "A"]) for _ in range(rng.randint(0, 25))),
                     lang, source))
    return rows + rows[20:30]


def plain(x):
    if x is None or pd.isna(x):
        return None
    return int(x) if not isinstance(x, (str, bool)) and x == int(x) and abs(x) < 2 ** 53 else x


def as_set(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


def duck(docs, sql):
    con = duckdb.connect()
    con.register("given", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    con.sql("create table documents as select * from given")
    cursor = con.sql(sql)
    return pd.DataFrame(cursor.fetchall(), columns=cursor.columns, dtype=object)


AUDIT = ["lang", "source", "part", "item", "value", "rank"]
MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def merkle_rows(docs):
    found = mf.manifest(docs)
    return found.select("doc_id", "leaf", "subroot", "root", mf.proof(F.col("path")).alias("proof_sha256"),
                        mf.fold(F.col("path"), F.col("altered")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_merkle_manifest"])
def test_queries_equal_their_sql(spark, oracle, small, name):
    got = LLM_QUERIES[name](spark, small).toPandas()
    want = oracle(LLM_ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert as_set(got, list(got.columns)) == as_set(want, list(got.columns))


def test_divergence_of_odd_tables(spark):
    docs = documents(spark, odd_rows())
    want = as_set(duck(docs, DIVERGENCE), AUDIT)
    assert any(r[2] == "term" for r in want) and any(r[2] == "pair" and r[4] == 0 for r in want)
    assert as_set(dv.divergence_audit(docs).toPandas(), AUDIT) == want
    # the way of many sources, and texts in slices of their own
    assert as_set(dv.divergence_audit(docs, few=0).toPandas(), AUDIT) == want
    assert dv.divergence_audit(docs.limit(0)).count() == 0


def test_slices_do_not_change_counts(spark, monkeypatch):
    docs = documents(spark, odd_rows()).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    whole = as_set(dv.term_counts(docs).toPandas(), ["lang", "source", "term", "n", "docs"])
    monkeypatch.setattr(dv, "SLICE_BYTES", 40)
    assert as_set(dv.term_counts(docs).toPandas(), ["lang", "source", "term", "n", "docs"]) == whole


def test_levels_end_at_the_top_ranks(spark):
    # 500 terms of one value: the first in UTF-8 order are kept
    text = " ".join(f"t{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(500))
    rows = [(i, text, "en", "a") for i in range(3)] + [(9 + i, "zz", "en", "b") for i in range(50)]
    got = dv.divergence_audit(documents(spark, rows)).filter("source = 'a' and part = 'term'").toPandas()
    assert len(got) == 200 and got["value"].nunique() == 1
    assert got.sort_values("rank")["item"].tolist() == sorted(text.split())[:200]


def test_frequencies_are_exact_beyond_64_bits(spark):
    n, v = 9 * 10 ** 15, 10 ** 9
    row = spark.range(1).select(dv._p(F.lit(n - 7), F.lit(n), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (n - 6) // (n + v)


def plain_tree(digests):
    paths = [[] for _ in digests]
    level = [(d, [i]) for i, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 16):
            run = level[at:at + 16]
            for j, (_, members) in enumerate(run):
                for i in members:
                    paths[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1:])))
            above.append((sha("".join(d for d, _ in run)), [i for _, m in run for i in m]))
        level = above
    return level[0][0], paths


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, text, lang, source):
        return sha("".join(map(enc, (doc_id, source, lang, None if text is None else len(text), text))))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((leaf(*r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        members = sorted(by_source[name], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append((members, *plain_tree([d for d, _ in members])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), beyond in zip(trees, upper):
        for (d, r), path in zip(members, paths):
            path = path + beyond
            x = d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = leaf(r[0], r[1] and r[1].translate(lower), *r[2:])
            for left, right in path:
                x = sha(left + x + right)
            out.append((r[0], d, subroot, root, sha("".join(a + b for a, b in path)), x, x == root))
    return sorted(out, key=repr)


def test_manifest_of_odd_tables(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    want = plain_manifest(rows)
    got = sorted((tuple(r) for r in merkle_rows(docs).collect()), key=repr)
    assert got == want and any(not r[-1] for r in got)
    assert as_set(duck(docs, MANIFEST), MERKLE) == want
    assert merkle_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4100])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"Text {i}", "en", "s") for i in range(n)]
    got = sorted((tuple(r) for r in merkle_rows(documents(spark, rows)).collect()), key=repr)
    assert got == plain_manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 300}") for i in range(400)]
    got = sorted((tuple(r) for r in merkle_rows(documents(spark, rows)).collect()), key=repr)
    assert got == plain_manifest(rows)


def plain_targets(sizes):
    total = sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(total)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


def check_mix(docs, slack):
    got = mx.mix_sources(docs).toPandas()
    texts = docs.select("doc_id", "text", "source").toPandas()
    words = texts.text.map(lambda t: 0 if t is None else len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    sizes = words.groupby(texts.source.where(texts.source.notna(), None), dropna=False).sum()
    sizes = {(None if pd.isna(k) else k): int(v) for k, v in sizes.items()}
    targets = plain_targets(sizes)
    assert sorted(zip(map(plain, got.doc_id), got["size"]), key=repr) == sorted(zip(map(plain, texts.doc_id), words), key=repr)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    assert (got.taken % got["size"].clip(lower=1) == 0).all()
    found = {}
    for (size, target), part in got.groupby(["source_size", "target"]):
        found.setdefault((size, round(target, 6)), []).append(int(part.taken.sum()))
    want = defaultdict(list)
    for s, n in sizes.items():
        want[(n, round(targets[s], 6))].append(targets[s])
    assert {k: None for k in found} == {k: None for k in want}
    for key, taken in found.items():
        assert abs(sum(taken) - sum(want[key])) <= slack * len(want[key]), (key, taken, want[key])
    return got


def test_mix_of_odd_tables(spark):
    docs = documents(spark, [r for r in odd_rows() if r[0] != 12])
    got = check_mix(docs, 30)
    # a document that is nearly all of its source is taken or not, whichever is nearer
    large = mx.mix_sources(documents(spark, odd_rows())).filter("doc_id = 12").first()
    assert large.taken == large["size"] == 30000 and large.target < 30000
    again = mx.mix_sources(docs.repartition(7, "text")).toPandas()
    columns = list(got.columns)
    assert columns == ["doc_id", "size", "source_size", "target", "taken"] and as_set(got, columns) == as_set(again, columns)
    assert mx.mix_sources(docs.limit(0)).count() == 0
    nothing = mx.mix_sources(documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).toPandas()
    assert nothing.taken.tolist() == [0, 0] and nothing.target.tolist() == [0.0, 0.0]


@pytest.mark.parametrize("arity, reserve", [(16, 64), (3, 4)])
def test_mix_reaches_its_targets(spark, monkeypatch, arity, reserve):
    monkeypatch.setattr(mx, "ARITY", arity)
    monkeypatch.setattr(mx, "RESERVE", reserve)
    rng = random.Random(4)
    rows = [(i, "w " * int(2 ** rng.uniform(0, 11)), "en", rng.choice("aaaaab") + rng.choice(["", "x"])) for i in range(3000)]
    check_mix(documents(spark, rows), 25)


def test_mix_caps_small_sources(spark):
    rows = [(i, "w " * (i % 5 + 1), "en", "a" if i < 5 else "b" if i < 30 else "c") for i in range(2000)]
    got = check_mix(documents(spark, rows), 5)
    assert (got.target == 3.0 * got.source_size).sum() == 30


def test_copies_keep_their_expectation(spark):
    # over many trees alike, a document is picked as often as its probability says, where
    # the smaller ones can offset it both ways; that holds for the large ones of a long list
    rows = spark.range(300 * 100).selectExpr(
        "id div 100 as tree", "id % 100 as doc_id", "1 + (id % 100) * (id % 100 % 7) as size", "0.3D as p")
    picked = mx.round_copies(rows).groupBy("doc_id").agg(F.avg("extra").alias("share"), F.count("*").alias("n")).collect()
    assert len(picked) == 100 and all(r.n == 300 for r in picked)
    large = [r.share for r in picked if 1 + r.doc_id * (r.doc_id % 7) >= 200]
    assert len(large) > 25 and all(0.2 < x < 0.4 for x in large), sorted(large)
    assert abs(sum(large) / len(large) - 0.3) < 0.02


def test_rank_within_groups(spark):
    rows = [(g, v) for g in (None, "a", "b") for v in (3, 1, None, 2, 2)]
    got = rank_within(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()
    for g in (None, "a", "b"):
        part = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in part] == [0, 1, 2, 3, 4] and {r["size"] for r in part} == {5}
        assert [r.v for r in part] == [None, 1, 2, 2, 3]
    assert rank_within(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0
    small = spark.createDataFrame([("a", 1), ("b", 2)], "g string, w int")
    big = spark.createDataFrame([(g, v) for g, v in rows if g], "g string, v int")
    for bound in (0, 10):
        assert sorted(r.w for r in join_small(big, small, ["g"], 2, bound).collect()) == [1] * 5 + [2] * 5
