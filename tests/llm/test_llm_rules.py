"""URL filter, personal data, secrets: against plain definitions."""

import random
import re

import pytest

from faultloom.llm import pii, secrets
from faultloom.llm.queries import LLM_ORACLES, LLM_QUERIES, URL_RULES
from faultloom.llm.url_filter import filter_urls, filter_urls_joined

PAGES = [
    (1, "http://Example.COM/en/1"), (2, "https://www.example.com/en/"), (3, "http://a.net/es/?x"), (4, None), (5, "no"),
    (6, "http://example.com"), (7, "http://example.com/english"), (8, "x://net/fr/#a/b"), (9, "http://net?/es/"),
    (9, "http://net?/es/"), (10, "http:///en/"), (11, "http://examplecom/en/"), (12, "a://b://c.com/x\ny"),
]


def expected_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1])[0]
        host, _, path = rest.partition("/")
        path = rest[len(host):]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h.count("."), len(p), h + p, v) for v, h, p in URL_RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_filter_both_ways(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string").selectExpr("*", "'x' as host", "1 as rule")
    want = sorted((i, *expected_verdict(u)) for i, u in PAGES)
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(map(tuple, filter_urls(pages, URL_RULES).collect()), key=key) == want
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    assert sorted(map(tuple, filter_urls_joined(pages, rules).collect()), key=key) == want
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        filter_urls(pages, URL_RULES, max_rules=2)


def test_url_rule_ties_and_empty_host(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x/yz"), (2, None)], "page_id bigint, url string")
    rules = [("allow", "b", "/x/y"), ("block", "b", "/x/y"), ("allow", "", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    assert got == {1: ("b/x/y", "block"), 2: ("", "allow")}


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_sql_twin(spark, small, oracle, name):
    got = LLM_QUERIES[name](spark, small).toPandas()
    want = oracle(LLM_ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def plain_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        double = [x * 2 - 9 * (x * 2 > 9) if i % 2 else x for i, x in enumerate(d[::-1])]
        if 12 <= len(d) <= 19 and sum(double) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


CASES = [
    "", "a@b@c.com x", "a.b+c@d-e.f.g, z@y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255 01.002.0003.4", "4111 1111-1111 1111",
    "4111  1111", "+1 (555) 010-9999 +12 +1(((((((9", "é 10.0.0.1 ü+49 30 1234567", "0" * 15, "a" * 3000, "1." * 2000,
    "@" * 500, "x@y.z@w.v.u", "..@a.b", "１２３.1.1.1", "٣.1.1.1.1",
]


@pytest.mark.parametrize("text", CASES)
def test_personal_data_base(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_personal_data_base_on_documents(spark, small):
    for row in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        assert pii.base_spans(row.text) == plain_pii(row.text)


def test_personal_data_method(spark, texts):
    iban = "DE89 3704 0044 0532 0130 00"
    docs = texts([(1, f"konto {iban} X"), (2, "DE88 3704 0044 0532 0130 00"), (3, "social security 123-45-6789"),
                  (4, "123-45-6789"), (None, None), (5, "card 4111111111111111"), (5, "4111111111111111")], extra=True)
    got = [(r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans], [s.score for s in r.spans])
           for r in pii.find_personal_data(docs).collect()]
    assert ("iban", 6, 6 + len(iban), False) in got[0][1]
    assert not any(s[0] == "iban" for s in got[1][1])
    assert got[2][1] == [("ssn", 16, 27, False)] and got[3][1] == []
    assert got[4] == (None, [], [])
    assert got[5][2][0] > got[6][2][0]  # the context word
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def plain_secrets(text):
    found = [("assign", *m.span()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
        r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.BASE_KINDS.index(s[0])))


SECRETS = [
    "", "Password = 'abcdefghijkl'", "passwd:short token  :  \"aaaaaaaaaaaaa", "API_KEY=0123456789abcdef ApiKey: zzzzzzzzzzzz",
    "AKIA" + "A1" * 7, "AKIA" + "A" * 13, "ſecret=abcdefghijklmn toKen=abcdefghijklmn", "deadbeef" * 2 + "g", "İ token=abcdefghijklm",
    "token=token=abcdefghijkl", "f" * 15,
]


@pytest.mark.parametrize("text", SECRETS)
def test_secret_base(text):
    assert secrets.base_spans(text) == plain_secrets(text)


def test_secret_base_on_documents(spark, small):
    for row in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        assert secrets.base_spans(row.text) == plain_secrets(row.text)


def test_random_tokens_are_told_from_words(spark, texts):
    import base64
    import hashlib

    key = lambda i: base64.b64encode(hashlib.sha512(str(i).encode()).digest()).decode()[:40].replace("+", "x").replace("/", "y")
    prose = "the quick brown fox jumps over the lazy dog while many other animals are watching quietly from the hills "
    rows = [(i, f"{prose * 3}{key(i)} {prose}") for i in range(60)] + [(100 + i, prose + "xyxyxyxyxyxyxyxyxyxy_" * 2) for i in range(5)]
    docs = texts([*rows, (None, None), (7, "")], extra=True)
    found = {r.doc_id: [s for s in r.spans if not s.base] for r in secrets.find_secrets(docs).collect()}
    hit = sum(any(s.kind == "random" and s.end - s.start == 40 for s in found[i]) for i in range(60) if i != 7)
    assert hit >= 55
    assert not any(found[100 + i] for i in range(5))
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert clean[100] == rows[60][1] and clean[None] is None
    assert sum("[SECRET]" in (clean[i] or "") for i in range(60)) >= 55
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    assert secrets.fit_thresholds(docs.limit(0)) == [-1] * len(secrets.LENGTHS)


OTHER_SCRIPTS = {
    "cyrillic": "утром инженер проверил сервер и записал сообщения которые пришли ночью от машин ",
    "cjk": "今天早上工程师检查了服务器并记录了夜里机器发来的消息 ",
    "mixed": "утром engineer 检查了 server und notierte die messages которые kamen ",
}


@pytest.mark.parametrize("script", sorted(OTHER_SCRIPTS))
def test_plain_names_stay_in_texts_of_any_script(spark, texts, script):
    rng = random.Random(script)
    words = "server message engineer morning machine storage careful reading update monitor request handler".split()
    around = OTHER_SCRIPTS[script]
    names = lambda: [f"{rng.choice(words)}_{rng.choice(words)}_{rng.choice(words)}" for _ in range(2)]
    plain = [(i, around + f" {around}".join(names())) for i in range(400)]
    found = secrets.find_secrets(texts(plain)).collect()
    assert sum(len(r.spans) for r in found) <= 8
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "".join(rng.choice(letters) for _ in range(48))
    hidden = [(1000 + i, around + key() + " " + around) for i in range(100)]
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(texts(plain + hidden)).collect()}
    assert sum(len(spans[i]) == 1 and spans[i][0].kind == "random" for i in range(1000, 1100)) >= 85
    assert sum(len(spans[i]) for i in range(400)) <= 8


def test_decoys_fit_their_tokens():
    near = "the quick brown fox jumps over the lazy dog"
    for token, want in (("aB3dE6gH9jK2mN5pQ8rS", "base62"), ("abc_def-ghi_jkl_mnop", "base64url"), ("ABCD2345EFGH6789JKLM", "BASE36"),
                        ("abcdefghijklmnopqrst", "lower"), ("DEADBEEF0123456789AB", "HEX"), ("ab+cd/ef+gh/ij+kl/mn", "base64")):
        kind = secrets.encoding_of(token)
        assert kind[0] == want
        for beside in (near, "", "только кириллица"):
            made = secrets.decoy(token, want, beside)
            assert len(made) == len(token) and made == secrets.decoy(token, want, beside)
            assert set(made) <= kind[1].keys(), (token, made)
    assert secrets.randomness("not_in_hex", secrets.ENCODINGS[1]) == 1.0


def test_thresholds_follow_their_definition(spark, texts):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "some words about servers " + ("".join(rng.choice(letters) for _ in range(rng.choice([40, 64, 70]))) if i % 2 else
                                               "ordinary_words_that_join_as_names_do_in_programs")) for i in range(300)]
    want = []
    judged = [(secrets.length_class(e - s), secrets.score_bin(p), secrets.score_bin(q)) for _, t in rows
              for s, e, p, q in secrets.candidates(t)]
    for k in range(len(secrets.LENGTHS)):
        fine = [b for b in range(secrets.BINS)
                if (n := sum(c == k and p <= b for c, p, _ in judged)) and
                1 + sum(c == k and q <= b for c, _, q in judged) <= secrets.ALPHA * n]
        want.append(max(fine, default=-1))
    assert secrets.fit_thresholds(texts(rows)) == want and max(want) >= 0


def test_cover_joins_overlapping_spans():
    spans = [{"start": 1, "end": 4}, {"start": 2, "end": 6}, {"start": 3, "end": 4}, {"start": 8, "end": 9}]
    assert secrets.cover("0123456789", spans, "#") == "0#67#9"
