"""SimHash, embeddings, components, decontamination: against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from faultloom.llm import decontaminate as dc
from faultloom.llm import embeddings as em
from faultloom.llm import simhash as sh
from faultloom.llm.graph import components


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    odd = [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000), (7000, 7001)]
    edges = spark.createDataFrame(chain + hub + odd, "u bigint, v bigint").repartition(8)
    got = {r.node: r.rep for r in components(edges).collect()}
    groups = {}
    for node, rep in got.items():
        groups.setdefault(rep, set()).add(node)
    assert sorted(map(min, groups.values())) == [0, 1000, 7000]
    assert sorted(map(len, groups.values())) == [2, 200, 301]
    assert components(edges.limit(0)).count() == 0


def plain_fingerprint(text, shingle=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return value - (1 << 64) if value >> 63 else value


TEXTS = ["", " \t\n", None, "A", "a b", "a b c", "a\u00a0b c d é É", "the cat sat " * 50, "x " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert sh.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("the cat sat",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("the cat sat", 42)


def apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bits,limit", [(2, 512), (2, 2), (3, 512), (3, 2), (1, 512), (4, 3)])
def test_links_connect_as_all_pairs(spark, monkeypatch, bits, limit):
    monkeypatch.setattr(sh, "CELL_LIMIT", limit)
    rng = random.Random(bits * 7 + limit)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(8):
            for _ in range(rng.randint(1, bits + 1)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted({signed(x) for x in prints} | {0, 1, 3, -1, -2})
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    edges = [(r.u, r.v) for r in sh.links(df, bits).collect()]
    want = brute_components(prints, lambda a, b: apart(a, b) <= bits)
    pairs = set(edges)
    assert brute_components(prints, lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def test_group_near_duplicates(spark, texts, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(9001, None), (9002, ""), (9003, " "), (9001, None), (None, "unlike any other text here"), (9004, rows[0][1])]
    got = sh.group_near_duplicates(texts(rows, extra=True)).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    by_print = {}
    for i, f in prints.items():
        by_print[f] = min(i, by_print.get(f, i))
    roots = brute_components(by_print, lambda a, b: apart(a, b) <= 2)
    lowest = {}
    for f, r in roots.items():
        lowest[r] = min(by_print[f], lowest.get(r, by_print[f]))
    for r in got:
        if r.doc_id is not None:
            assert (r.fp, r.component_id) == (prints[r.doc_id], lowest[roots[prints[r.doc_id]]])
    kept = sh.drop_near_duplicates(texts(rows, extra=True))
    assert kept.columns == texts(rows, extra=True).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([*lowest.values(), None], key=str)
    assert sh.group_near_duplicates(texts([])).count() == 0
    assert sh.drop_near_duplicates(texts([])).count() == 0


def brute_vectors(rows):
    unit = {}
    for i, v in rows:
        if v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v):
            x = np.array(v, dtype=float)
            x = x / np.abs(x).max()
            unit[i] = x / np.sqrt(x @ x)
    linked = lambda a, b: a in unit and b in unit and float(unit[a] @ unit[b]) >= 0.95
    ids = [i for i, _ in rows]
    roots = brute_components(ids, linked)
    return {i: (sum(linked(i, j) for j in ids if j != i), roots[i], roots[i] == i) for i in ids}


@pytest.mark.parametrize("chunk", [2, 256])
def test_embeddings(spark, monkeypatch, chunk):
    monkeypatch.setattr(em, "BASE_CHUNK", chunk)
    monkeypatch.setattr(em, "PROBE_CHUNK", chunk + 1)
    monkeypatch.setattr(em, "PER_CELL", 4)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        x = rng.normal(size=8)
        for _ in range(c % 7 + 1):
            rows.append((len(rows), (x + rng.normal(size=8) * 0.08).tolist()))
    nan, inf = float("nan"), float("inf")
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [nan] + [1.0] * 7), (504, [inf] * 8),
             (505, [None] + [1.0] * 7), (506, [1.0] * 5), (507, [1e300] * 8), (508, [1e-300] * 8), (509, [2.0] * 8),
             (510, rows[0][1]), (511, rows[0][1]), (512, [3 * x for x in rows[0][1]])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr(
        "*", "1 as unit", "2 as key", "3 as cell", "4 as links")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.link_embeddings(vectors, target_recall=1.0).collect()}
    want = brute_vectors(rows)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert len(got) == len(rows) and 0.98 * there <= found <= there
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(got[i] == want[i] for i in range(500, 513))
    assert em.link_embeddings(vectors.limit(0)).count() == 0
    nothing = em.link_embeddings(vectors.filter("vec_id between 500 and 505")).collect()
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in nothing)


@pytest.mark.parametrize("n, distinct", [(1, 1), (2, 2), (3, 3), (64, 64), (65, 65), (200, 1), (70, 64)])
def test_small_tables_of_embeddings(spark, n, distinct):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(distinct, 8))
    rows = [(i, x[i % distinct].tolist()) for i in range(n)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.link_embeddings(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == brute_vectors(rows)


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6 if i < 40 else 8).tolist()) for i in range(100)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300 + i, rows[50 + i][1]) for i in range(20)]
    rows += [(400, [1.0]), (401, [2.0]), (402, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.link_embeddings(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert all(got[200 + i] == (1, i, False) and got[300 + i] == (1, 50 + i, False) for i in range(20))
    assert got[400] == (1, 400, True) and got[401] == (1, 400, False) and got[402] == (0, 402, True)


def test_embedding_recall(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small.replace('0.001', '0.01')}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    there = int(((x @ x.T) >= 0.95).sum() - len(x))
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sum(r.n_links for r in em.link_embeddings(vectors).collect())
    assert 0.9 * there <= found <= there


def test_embedding_recall_of_planted_partners(spark):
    """Default parameters, isotropic rows, partners at cosine 0.95 to 0.97, dozens of codewords."""
    n, planted, d = 40_000, 4_000, 64
    rng = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n, d)))
    side = rng.normal(size=(planted, d))
    side = unit(side - (side * x[:planted]).sum(1, keepdims=True) * x[:planted])
    cos = rng.uniform(0.95, 0.97, size=(planted, 1))
    x = np.concatenate([x, cos * x[:planted] + np.sqrt(1 - cos ** 2) * side])
    there = sum(int(((x[i:i + 4000] @ x.T) >= 0.95).sum()) for i in range(0, len(x), 4000)) - len(x)
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()})
    vectors = spark.createDataFrame(frame, "vec_id bigint, embedding array<double>").repartition(8)
    assert there >= 2 * 0.99 * planted
    found = sum(r.n_links for r in em.link_embeddings(vectors).collect())
    assert 0.985 * there <= found <= there


def test_depth_holds_for_unseen_vectors(spark, monkeypatch):
    monkeypatch.setattr(em, "PER_CELL", 0.3)  # as many codewords as a table of millions
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    seen, fresh = unit(rng.normal(size=(20_000, 64))), unit(rng.normal(size=(2_000, 64)))
    distinct = spark.createDataFrame([(i, bytearray(v.tobytes()), 1) for i, v in enumerate(seen)],
                                     "key bigint, unit binary, n bigint")
    index = em.fit_index(distinct, len(seen), em.THRESHOLD, em.TARGET_RECALL, em.SAMPLE)
    assert len(index.books[0]) > 200
    side = rng.normal(size=fresh.shape)
    side = unit(side - (side * fresh).sum(1, keepdims=True) * fresh)
    partner = em.THRESHOLD * fresh + np.sqrt(1 - em.THRESHOLD ** 2) * side
    met = np.minimum(index.rank(fresh, partner), index.rank(partner, fresh)) <= index.depth
    assert met.mean() >= 0.99


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, "item"), (4, ""),
         (5, None), (None, "alpha beta"), (6, "zero one two three four five six seven eight nine ten"),
         (7, "a a a a a a a a a a a a"), (1, "second text of item one with more than ten words in all of it")]


def brute_hits(text):
    lower = lambda t: __import__("re").findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    run, hit, items = lower(text), set(), set()
    for item, t in ITEMS:
        w = lower(t)
        k = min(len(w), 10)
        if item is None or not w:
            continue
        windows = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(run) - k + 1):
            if tuple(run[i:i + k]) in windows:
                hit |= set(range(i, i + k))
                items.add(item)
    return len(run), hit, sorted(items)


def test_decontamination_against_brute_force(spark, texts):
    rng = random.Random(3)
    words = "zero one two three four five six seven eight nine ten eleven twelve a short item Item second text of".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, "x, " + " ".join(words[i % 4:9 + i % 6]) + ". é " + "a-" * (8 + i)) for i in range(8)]
    rows += [(200, None), (201, ""), (202, ITEMS[0][1].upper()), (202, ITEMS[0][1].upper()), (None, "short ITEM"),
             (203, "\u00e9one " + ITEMS[8][1])]
    docs = texts(rows, extra=True)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for size in (64 << 20, 60):  # in one block, and in several
        got = dc.find_contamination(docs, items, max_bytes=size).collect()
        key = lambda x: str(x[0])
        want = sorted(((i, *brute_hits(t)) for i, t in rows), key=key)
        seen = sorted(((r.doc_id, r.n_words, {p for h in r.hits for p in range(h["from"], h["to"])}, list(r["items"]))
                       for r in got), key=key)
        assert seen == want
    clean = dc.remove_contamination(docs, items)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert 202 not in left and left[200] is None and left[201] == ""
    for i, t in rows:
        hit = brute_hits(t)[1]
        if i in left and not hit:
            assert left[i] == t
    assert dc.find_contamination(docs, items.limit(0)).filter("size(hits) > 0").count() == 0
    assert dc.find_contamination(docs.limit(0), items).count() == 0


def test_cut_spans():
    text = "Keep, ONE two; three é."
    assert dc.cut_spans(text, [{"from": 1, "to": 3}]) == "Keep, ; three é."
    assert dc.cut_spans(text, [{"from": 1, "to": 3}], min_words=3) == text
