"""Secret scan: fixed patterns, plus tokens that a battery of randomness tests finds random."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array, bound_batches, column, map_rows

BASE_KINDS = ("assign", "access", "hex")
SPANS = "spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
# a run of 16 or more is the same as a whole run filtered by its length
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
# lengths at which a new class begins: shorter tokens carry less evidence, so each
# class is held to the false-discovery rate by itself
LENGTHS = (16, 20, 24, 32, 40, 64, 128, 512)
ALPHA = 0.05
POOL = 24   # words that a decoy is made from, at least
BINS = 64  # of the score, four to a power of ten

# fixed values: a word, and the letters of English text by their share in it
WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,15}(?![A-Za-z0-9])")
LETTERS = "".join(c * n for c, n in zip("abcdefghijklmnopqrstuvwxyz", (
    82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# encodings from the narrowest; a token is judged in the first that holds all of it
ENCODINGS = tuple((name, {c: i for i, c in enumerate(alphabet)}) for name, alphabet in (
    ("decimal", DIGITS), ("hex", DIGITS + LOWER[:6]), ("HEX", DIGITS + UPPER[:6]),
    ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("base62", DIGITS + LOWER + UPPER),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
))


def _kind(c: str) -> int:
    return 0 if c in DIGITS else 1 if c in LOWER else 2 if c in UPPER else 3


# kind of character -> its share of an encoding's alphabet
KIND_SHARES = {name: {k: m / len(alphabet) for k, m in Counter(map(_kind, alphabet)).items()}
               for name, alphabet in ENCODINGS}


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(token: str) -> tuple[str, dict[str, int]] | None:
    chars = set(token)
    return next(((n, a) for n, a in ENCODINGS if chars <= a.keys()), None)


def randomness(token: str, kind: tuple[str, dict[str, int]] | None = None) -> float:
    """p-value of "drawn evenly and independently from its encoding", in (0, 1]; 1 for what
    is not in the encoding given.

    Fisher's combination of a chi-squared test of even use of the alphabet, one of its
    kinds of characters (capitals, small letters, digits, signs) where it has several, a
    runs test over its two halves and a test of the correlation of neighbours, each with a
    normal approximation at the token's length.
    """
    if kind is not None and not set(token) <= kind[1].keys():
        return 1.0
    kind = kind or encoding_of(token)
    n = len(token)
    if kind is None or n < 8:
        return 1e-30
    x = np.fromiter(map(kind[1].__getitem__, token), dtype=np.float64, count=n)
    k = len(kind[1])
    counts = np.bincount(x.astype(np.int64), minlength=k)
    chi = float((counts * counts).sum()) * k / n - n
    ps = [_upper_tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    shares = KIND_SHARES[kind[0]]
    if len(shares) > 1:
        seen = Counter(map(_kind, token))
        misfit = sum((seen[c] - n * share) ** 2 / (n * share) for c, share in shares.items())
        df = len(shares) - 1
        # the cube root of a chi-squared sum is close to normal
        ps.append(_upper_tail(((misfit / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))))
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = 1 + int((high[1:] != high[:-1]).sum())
        ps.append(2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    d = x - x.mean()
    spread = float(d @ d)
    r = float(d[1:] @ d[:-1]) / spread if spread else 1.0
    ps.append(2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    half = -sum(math.log(max(p, 1e-12)) for p in ps)
    return max(1e-30, math.exp(-half) * sum(half ** i / math.factorial(i) for i in range(len(ps))))


def length_class(n: int) -> int:
    return max(i for i, low in enumerate(LENGTHS) if n >= low)


def score_bin(p: float) -> int:
    """0 for p near 1, larger for less random tokens."""
    return min(BINS - 1, int(-4 * math.log10(p)))


def _ordinary_words(token: str, near: str) -> Iterator[str]:
    """Words drawn by the token's hash, without end, from those of the text beside it and,
    if these are fewer than POOL, from words with the letter shares of English."""
    state = zlib.crc32(token.encode())

    def draw(n: int) -> int:
        nonlocal state
        state = (state * 1103515245 + 12345) % 2 ** 31
        return (state >> 8) % n

    words = [w.lower() for w in WORD.findall(near)]
    words += ["".join(LETTERS[draw(len(LETTERS))] for _ in range(3 + draw(7))) for _ in range(POOL - len(words))]
    while True:
        yield words[draw(len(words))]


def decoy(token: str, kind: str, near: str) -> str:
    """An ordinary token of the same length and encoding: words joined as names are.

    Mixed case becomes capitals at the begin of words, the token's own joining signs go
    between them, its digits (four at most) stand together at the end.
    """
    n = len(token)
    digits = "".join(c for c in token if c in DIGITS)[:4]
    signs = [c for c in token if not c.isalnum()]
    mixed = kind in ("base62", "base64", "base64url") and any(c in UPPER for c in token)
    words, out = _ordinary_words(token, near), ""
    while len(out) < n - len(digits):
        word = next(words)
        if kind in ("hex", "HEX"):
            word = "".join(c for c in word if c in "abcdef")
        if mixed and word:
            word = word[0].upper() + word[1:]
        out += (signs[len(out) % len(signs)] if signs and out else "") + word
    out = out[:n - len(digits)] + digits
    return out.upper() if kind in ("upper", "HEX", "base32", "BASE36") else out


def candidates(text: str) -> Iterator[tuple[int, int, float, float]]:
    """(start, end, p, p of its decoy).

    Decimal numbers are no candidates; padding ``=`` stays outside the span. A decoy is
    judged in the encoding of its token; one that does not fit it counts as random.
    """
    for m in CANDIDATE.finditer(text):
        token, (start, end) = m[0], m.span()
        kind = encoding_of(token)
        if kind is None or kind[0] == "decimal":
            continue
        near = text[max(0, start - 8 * len(token)):start]
        yield start, end, randomness(token), randomness(decoy(token, kind[0], near), kind)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base kinds, by start, then kind; offsets are code points."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def fit_thresholds(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA) -> list[int]:
    """The last score bin accepted in each length class (-1: none), over all documents.

    Target-decoy control: with each candidate token the same battery judges an ordinary
    token of its length and encoding, made of words near it. In a length class, accepting bins 0..b makes
    (1 + decoys) / candidates an estimate of the share of false discoveries; the
    largest b that keeps it at ``alpha`` or less is taken. Only the counts by length
    class and bin (at most 8 x 64 rows) come to the driver. Empty tables and nulls
    give -1 everywhere.
    """

    def judge(batch: pa.RecordBatch):
        seen: dict[tuple[int, int], list[int]] = {}
        for text in column(batch, "text"):
            for start, end, p, q in candidates(text) if text else ():
                k = length_class(end - start)
                seen.setdefault((k, score_bin(p)), [0, 0])[0] += 1
                seen.setdefault((k, score_bin(q)), [0, 0])[1] += 1
        yield {"k": [x[0] for x in seen], "bin": [x[1] for x in seen],
               "targets": [v[0] for v in seen.values()], "decoys": [v[1] for v in seen.values()]}

    rows = map_rows(docs.select(F.col(text_col).alias("text")), judge,
                    "k int, bin int, targets bigint, decoys bigint")
    counts = rows.groupBy("k", "bin").agg(F.sum("targets"), F.sum("decoys")).collect()
    table = np.zeros((len(LENGTHS), BINS, 2), dtype=np.int64)
    for k, b, targets, decoys in counts:
        table[k, b] = targets, decoys
    targets, decoys = table.cumsum(axis=1).transpose(2, 0, 1)
    fine = (targets > 0) & ((1 + decoys) <= alpha * targets)
    return [int(np.flatnonzero(row).max(initial=-1)) for row in fine]


def all_spans(text: str, thresholds: list[int]) -> list[dict]:
    """Base spans with score 1, and accepted random tokens as kind ``random``."""
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "score": 1.0, "base": True} for k, s, e in base]
    for start, end, p, _ in candidates(text):
        if score_bin(p) <= thresholds[length_class(end - start)]:
            out.append({"kind": "random", "start": start, "end": end, "score": p, "base": False})
    order = {k: i for i, k in enumerate((*BASE_KINDS, "random"))}
    return sorted(out, key=lambda s: (s["start"], order[s["kind"]]))


def find_secrets(docs: DataFrame, thresholds: list[int] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, by start, then kind.

    Without ``thresholds`` they are fitted on these documents first. Null and empty
    texts have no spans, repeated rows are scanned one by one, a null id stays null, an
    empty table gives an empty one; other columns are not read.
    """
    limits = fit_thresholds(docs, text_col) if thresholds is None else thresholds

    def scan(batch: pa.RecordBatch):
        yield {"id": array(batch, "id"),
               "spans": [all_spans(t, limits) if t else [] for t in column(batch, "text")]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, scan, f"id bigint, {SPANS}").withColumnRenamed("id", id_col)


def cover(text: str, spans: list[dict], mark: str) -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for span in spans:
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at:span["start"]], mark]
        at = max(at, span["end"])
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
                   thresholds: list[int] | None = None) -> DataFrame:
    """The documents, all columns kept, with every secret in ``text_col`` replaced.

    Documents without a secret, nulls included, come out as they were.
    """
    limits = fit_thresholds(docs, text_col) if thresholds is None else thresholds
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and cover(t, all_spans(t, limits), mark) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(clean, docs.schema)
