"""Toxicity, languages, SentencePiece, token counts and the pipeline."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from faultloom.llm import langid, toxicity
from faultloom.llm import sentencepiece_scan as sp
from faultloom.llm.queries import LLM_QUERIES
from faultloom.llm.simhash import fingerprint
from faultloom.llm.token_counts import TokenRollup, copies, count_tokens

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pieces():
    return sp.load_pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(found):
    return np.frombuffer(found, dtype=np.int32).tolist()


ODD = ["", " ", "  a  b ", "a\nb\n\n c", "\n", "▁x▁", "aaaaaaaaaaaaaaaaaaaa", " " * 37 + "x", "ththththththth", "日本語 テスト ☃ \U0001f600",
       "é \x00 \t", "<s> </s> <unk> <0x41>", "anananananan banana", "1234567890 !!!??? $$$"]


@pytest.mark.parametrize("text", ODD)
def test_encoding_of_odd_texts(pieces, library, text):
    assert ids(pieces.text(text)) == library.encode(text)
    assert pieces.decode(library.encode(text)) == text.replace("▁", " ")


def test_encoding_of_random_texts(pieces, library):
    rng = random.Random(1)
    for alphabet in ("ab ", "the n", "ener ung\n", " ▁a", "étà l'", "xX0_-. "):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert ids(pieces.text(text)) == library.encode(text), text


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 20, 1000])
def test_chunks_give_the_whole_texts_encoding(pieces, library, chunk):
    rng = random.Random(chunk)
    texts = ODD[1:] + ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in
                       ("the n", "thing", "internation", "ab \n", "aaab") for _ in range(20)]
    for text in texts:
        found = list(sp.parts(pieces.escape(text), chunk, pieces.longest))
        matrices = [sp.transfer(pieces, p) for p in found]
        parts = [sp.backtrace(pieces, p, *x) for p, x in zip(found, sp.borders(matrices))]
        assert ids(b"".join(parts)) == library.encode(text), (text, chunk)


def test_products_are_associative(pieces):
    text = pieces.escape("internationalisation of the thththings everywhere " * 3)
    m = [sp.transfer(pieces, p) for p in sp.parts(text, 9, pieces.longest)]
    left = right = None
    for x in m:
        left = x if left is None else sp.compose(left, x)
    for x in reversed(m):
        right = x if right is None else sp.compose(x, right)
    assert left[0, 0] == right[0, 0]


def test_encode_and_decode_tables(spark, texts, pieces, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "the thing " * 40), (50, "the thing " * 40), (None, None),
                                                 (51, "x" * 200), (None, "long " * 50)]
    docs = texts(rows, extra=True)
    got = sp.encode(docs, pieces, keep=("text", "key"), chunk=30)
    assert got.columns == ["doc_id", "text", "key", "token_ids", "round_trip"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    for r in found:
        assert r.token_ids == library.encode(r.text or "")
    back = sp.decode(got.filter("doc_id is not null").dropDuplicates(["doc_id"]), pieces)
    want = {i: t.replace("▁", " ") for i, t in rows if i is not None}
    assert {r.doc_id: r.text for r in back.collect()} == want
    assert sp.encode(docs.limit(0), pieces).count() == 0


@pytest.mark.parametrize("token,word", [
    ("1d10t", "idiot"), ("st00pid", "stoopid"), ("m0r0n", "moron"), ("$cum", "scum"), ("i.d.i.o.t", "idiot"),
    ("i d i o t", "idiot"), ("ididididiooooot", "ididididiot"), ("plain", "plain"), ("1984", None)])
def test_disguised_words(spark, texts, token, word):
    words = "idiot moron scum stoopid plain the and " * 30
    model = toxicity.language_model(texts([(1, words), (2, None)]))
    found = toxicity.restore(f"so {token}, then", toxicity.Decoder(model))
    assert found == [w for w in ("so", word, "then") if w]


def test_long_disguises_and_rows_of_words(spark, texts):
    words = "idiot moron scum stoopid plain the and you are a " * 30
    model = toxicity.language_model(texts([(1, words)]))
    decode = toxicity.Decoder(model, {w: 2.0 for w in words.split()})
    assert toxicity.restore("m" + "o" * 60 + "ron", decode) == ["moron"]
    assert toxicity.restore("m.0.r.o.n" + "!" * 50, decode) == ["moron"]
    assert toxicity.restore("you are a m o r o n", decode) == ["you", "are", "a", "moron"]
    row = ["you", "are", "a", "moron", "and", "the", "plain", "scum"] * 20  # over 40 characters
    assert toxicity.restore(" ".join("".join(row)), decode) == row
    assert toxicity.restore("i d i o t", decode) == ["idiot"]
    assert decode.split("xyzzyq") == ["xyzzyq"]
    long = "m0r0n" * 20_000  # linear: copied strings would take minutes
    assert len(decode(long)) == len(long)


def test_trigram_counts_do_not_depend_on_stretches():
    def trigrams(parts):
        seen = {}
        for part in parts:
            c = toxicity.classes(part).tolist()
            for i in range(len(c) - 2):
                seen[tuple(c[i:i + 3])] = seen.get(tuple(c[i:i + 3]), 0) + 1
        return seen

    rows = ["abc", "", None, "Hello wörld zz 日本"] * 5
    assert trigrams(toxicity._stretches(rows, 4)) == trigrams(toxicity._stretches(rows))


def test_toxicity_learns_and_restores(spark, texts):
    rng = random.Random(2)
    words = ["river", "mountain", "window", "garden", "silver", "paper", "morning", "letter"]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(10, 40))]
        if i % 4 == 0:
            text += rng.sample(["grumbler", "grumbling", "nastyword"], 2)
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, "river garden gr0mbler n4styw0rd n a s t y w o r d grumblers"), (901, None), (902, ""), (None, "paper"),
             (903, "river garden paper"), (903, "river garden paper")]
    labels += [(5, 1), (None, 1), (7, None)]
    docs = texts(rows, extra=True)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    got = [(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, model, keep=("doc_id",)).collect()]
    assert len(got) == len(rows)
    score = dict(got)
    assert all((score[i] >= 0.7) == (i % 4 == 0) for i in range(400) if i not in (5, 7))
    assert score[900] >= 0.7 and all(score[i] < 0.7 for i in (901, 902, 903, None))
    bare = toxicity.fit_toxicity(docs, marks.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, bare).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    kept = toxicity.score_toxicity(docs, bare, keep=tuple(docs.columns), score="own")
    assert kept.columns == [*docs.columns, "own"] and kept.first().score == "x"
    # a token that no task remembers
    long = [(1, "river " + "gr0mbler" * 12), (2, "q" * 5000)]
    assert {r.score >= 0.7 for r in toxicity.score_toxicity(texts(long), model).collect()} <= {True, False}
    assert max(map(len, model.known), default=0) <= toxicity.MEMO_CHARS
    assert kept.count() == len(rows) and kept.filter("doc_id = 0").first().text == rows[0][1]


def test_toxicity_held_out_accuracy(spark):
    got = LLM_QUERIES["op4_toxicity"](spark, MID)
    rows = got.join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert got.count() == 1000 and hits >= 0.7 * sum(r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.predicted for r in rows)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    got = LLM_QUERIES["op5_language_id"](spark, MID)
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert got.count() == 1000 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_corner_cases(spark, texts):
    rows = [(i, t) for i, t in enumerate(["the cat and the dog", "der Hund und die Katze"] * 40)]
    rows += [(900, None), (901, ""), (902, "123 !?"), (None, "the dog"), (903, "\U00020000\U00020001 日本"), (903, "the")]
    docs = texts(rows, extra=True).withColumn("lang", F.when(F.col("doc_id") < 80, F.when(
        F.col("doc_id") % 2 == 0, "en").otherwise("de")))
    model = langid.fit_language(docs)
    got = {r.doc_id: r for r in langid.predict_language(docs, model).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de" and got[None].lang_pred == "en"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert langid.predict_language(docs, model).count() == len(rows)
    nothing = langid.fit_language(docs.limit(0))
    assert {r.lang_pred for r in langid.predict_language(docs, nothing).collect()} == {"und"}
    assert (np.count_nonzero(model.weights) < 0.5 * model.weights.size) and model.temperature in langid.TEMPERATURES


def test_token_rollup(spark, texts, tmp_path):
    import base64

    import tiktoken

    from faultloom.llm.token_counts import PATTERN

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = [(1, "one two three"), (2, "four"), (3, None), (4, ""), (4, ""), (None, "nobody's"), (5, "one two three")]
    docs = texts(rows, extra=True).selectExpr("*", "if(doc_id = 2, null, 'en') as lang", "concat('s', doc_id % 2) as source")
    versions = {"v1": RANKS, "v2": RANKS}
    rollup = TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    counts = count_tokens(docs, versions)
    assert rollup.apply(1, counts) and not rollup.apply(1, counts)
    live = {i: (t, "en" if i != 2 else None, None if i is None else f"s{i % 2}") for i, t in rows}

    def check():
        want = {}
        for text, lang, source in live.values():
            for v in versions:
                n, total = want.get((source, lang, v), (0, 0))
                want[source, lang, v] = n + 1, total + len(encode(text or ""))
        assert {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()} == want

    check()
    deletes = counts.filter("doc_id in (2, 77)").unionByName(counts.filter("doc_id = 5").withColumn("doc_id", F.lit(78).cast("bigint")))
    assert rollup.apply(2, deletes, live=False)
    del live[2]
    check()
    moved = texts([(1, "one two"), (2, "back again")]).selectExpr("*", "'de' as lang", "'s9' as source")
    assert rollup.apply(5, count_tokens(moved, versions)) and not rollup.apply(2, deletes, live=False)
    live[1], live[2] = ("one two", "de", "s9"), ("back again", "de", "s9")
    check()
    with pytest.raises(ValueError):
        rollup.apply(4, counts)
    # a run that was lost before its commit leaves states behind; the next try replaces them
    counts.write.mode("overwrite").parquet(rollup._path("states", 6))
    check()
    assert rollup.apply(6, counts.filter("doc_id = 2"), live=False)
    del live[2]
    check()
    assert sorted(r.doc_id for r in copies(docs).collect()) == [5]


def test_documents_without_an_id_all_count(spark, tmp_path):
    rows = [(None, "one two three", "s", "en"), (None, "one", "s", "en"), (1, "one", "s", "en"), (None, "one", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    counts = count_tokens(docs, {"v": RANKS, "w": RANKS})
    rollup = TokenRollup(spark, str(tmp_path))
    assert rollup.apply(1, counts) and not rollup.apply(1, counts)
    got = {(r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert got == {("en", "v"): (3, 5), ("en", "w"): (3, 5), (None, "v"): (1, 1), (None, "w"): (1, 1)}
    rollup.apply(2, counts, live=False)
    got = {(r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert got == {("en", "v"): (2, 4), ("en", "w"): (2, 4), (None, "v"): (1, 1), (None, "w"): (1, 1)}


def test_token_count_query_against_recount(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    first, want = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    import re

    from faultloom.llm.token_counts import _encoding

    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"/opt/tokenizers/{version}.tiktoken", "rb") as file:
            encode = _encoding(version, file.read()).encode_ordinary
        for r in first.values():
            n, total = want.get((r.source, r.lang, version), (0, 0))
            tidy = re.sub(r"([ \t\n\x0b\f\r])[ \t\n\x0b\f\r]+", r"\1", r.text)
            want[r.source, r.lang, version] = n + 1, total + len(encode(tidy))
    got = LLM_QUERIES["op1_token_counts"](spark, small).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == want


def test_pipeline_stages(spark, library):
    before = spark.read.parquet(f"{MID}/documents.parquet")
    docs, kept = before, [before]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, MID)
        docs = docs.cache()
        kept.append(docs)
    start, clean, single, free, safe, tokens = kept
    for table in (clean, single, free, safe):
        assert table.columns == start.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    left = {r.doc_id for r in clean.collect()}
    gone = {r.doc_id for r in start.collect()} - left
    assert sum(labels.get(i, 0) for i in gone) >= 0.9 * sum(i in labels for i in gone)
    prints = {}
    for r in clean.collect():
        prints[r.doc_id] = fingerprint(r.text.encode())
    rows = {r.doc_id: r.text for r in single.collect()}
    seen = [(i, prints[i]) for i in sorted(rows)]
    assert not any(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for k, (_, a) in enumerate(seen) for _, b in seen[:k])
    for i, f in prints.items():  # whoever left has a near copy
        assert i in rows or any(((f ^ g) & (1 << 64) - 1).bit_count() <= 2 for j, g in prints.items() if j != i)
    passages = {r.doc_id: r.text for r in free.collect()}
    assert set(passages) <= set(rows) and len(passages) >= 0.95 * len(rows)
    redacted = {r.doc_id: r.text for r in safe.collect()}
    assert set(redacted) == set(passages) and not any("AKIA" in t for t in redacted.values())
    assert all("[SECRET]" in redacted[i] for i in redacted if redacted[i] != passages[i])
    for r in tokens.collect():
        assert r.round_trip and r.token_ids == library.encode(redacted[r.doc_id]) and r.n_tokens == len(r.token_ids)
    ran = corpus_pipeline.run(spark, MID)
    assert ran.columns == tokens.columns and ran.count() == tokens.count()
