"""Toxicity: noisy-channel restoration of disguised words, then a learned lexicon score."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import array, column, fold_of, map_rows, sample_ids

THRESHOLD = 0.7
TRAIN_ROWS = 20_000   # labelled rows the classifier is fitted on, at most
FEATURES = 1_500      # lexicon entries, at most
MIN_TOXIC = 5         # toxic training rows that must hold an entry
STEMS = (4, 5, 6)     # word beginnings that are entries beside whole words

# --- character language model ------------------------------------------------------------

SLOTS = 37            # classes for letters beyond a-z
SIZE = 27 + SLOTS     # 0: border or any other sign
_CLASS = np.zeros(0x3000, dtype=np.int32)
for _cp in range(len(_CLASS)):
    _c = chr(_cp)
    if "a" <= _c <= "z":
        _CLASS[_cp] = _cp - 96
    elif _cp >= 128 and _c.isalpha():
        _CLASS[_cp] = 27 + _cp % SLOTS


def classes(text: str) -> np.ndarray:
    """Class of each character of a lower-cased text; letters from U+3000 on go by
    their code point as well."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    if len(cp) and cp.max() >= len(_CLASS):
        return np.where(cp < len(_CLASS), _CLASS[np.minimum(cp, len(_CLASS) - 1)], 27 + cp % SLOTS).astype(np.int32)
    return _CLASS[cp]


def _stretches(texts: list[str | None], size: int = 1 << 18) -> Iterator[str]:
    """Lower-cased texts, two borders between them, in stretches of about
    ``size`` characters; a stretch starts with the last two characters of the one before."""
    held: list[str] = []
    n = 0
    for text in texts:
        low = f"\0\0{text.lower()}" if text else ""
        for at in range(0, len(low), size):
            held.append(low[at:at + size])
            n += len(held[-1])
            if n >= size:
                yield "".join(held)
                held, n = [held[-1][-2:]], 0
    yield "".join(held) + "\0"


def count_trigrams(docs: DataFrame, text_col: str) -> DataFrame:
    """``(code, n)``: class trigrams of every whole text, two borders in front. Tasks
    combine first, so a task writes at most SIZE ** 3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, dtype=np.int64)
        for batch in batches:
            for text in _stretches(column(batch, "text")):
                c = classes(text)
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE ** 3)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], names=["code", "n"])

    rows = docs.select(F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a class after two others, interpolated with shorter contexts.
    At most SIZE ** 3 counts come to the driver, whatever the corpus."""
    counts = np.zeros(SIZE ** 3)
    for code, n in count_trigrams(docs, text_col).toLocalIterator():
        counts[code] = n
    tri = counts.reshape(SIZE, SIZE, SIZE)
    bi = tri.sum(axis=0)
    uni = bi.sum(axis=0)
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 8 * p1) / (bi.sum(axis=1, keepdims=True) + 8)
    p3 = (tri + 8 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 8)
    return np.log(p3)


# --- noisy channel ---------------------------------------------------------------------------

# fixed values: letters a sign may stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SWAP, LITERAL, SHORTEN, DROP = 1.0, 6.0, 0.5, 0.2  # costs of the channel, in nats
_SIGNS = re.escape("".join(LEET))
_LETTER = r"[^\W\d_]"
# single characters in a row, apart by blanks; apart by other separators in a token
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?=[.,;:!?]*(?:\s|\Z))")
DOTTED = re.compile(rf"(?:[^\W_]|[{_SIGNS}])(?:[.\-_*](?:[^\W_]|[{_SIGNS}])){{2,}}\Z")
HIDDEN = re.compile(rf"[{_SIGNS}]")
REPEATED = re.compile(rf"({_LETTER})\1\1")
TRAIL = re.compile(r"([^\w\s])\1\1+\Z")  # a decoration of three or more equal signs
WORDS = re.compile(rf"{_LETTER}+")
NEW_WORD = 4.0        # cost of a word outside the vocabulary, in nats, beside that of its letters
VOCABULARY = 30_000   # words that rows of single characters are split into, at most
KNOWN = 120_000       # tokens whose entries a task remembers
MEMO_CHARS = 80       # longer tokens are decoded each time they occur


@dataclass
class Decoder:
    """Viterbi decoding of a token's character lattice under the language model. A row
    of single characters is then split into words, if there is a ``vocabulary`` (cost of
    a word, in nats): trigrams of characters alone do not tell where a word ends."""

    model: np.ndarray
    vocabulary: dict[str, float] = field(default_factory=dict)
    memo: dict[str, str] = field(default_factory=dict)
    room: int = 50_000
    slots: dict[tuple[str, int], list[tuple[str, list[int], float]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.vocabulary), default=0)

    def __call__(self, token: str) -> str:
        if len(token) > MEMO_CHARS:
            return self._read(token)
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) >= self.room:
                self.memo.clear()
            known = self.memo[token] = self._read(token)
        return known

    def _read(self, token: str) -> str:
        text = self._decode(token)
        return " ".join(self.split(text)) if " " in token and self.vocabulary else text

    def split(self, text: str) -> list[str]:
        """The cheapest words that make up the text: known ones at their cost, others at
        that of their letters and NEW_WORD. Linear in the text."""
        logp, kinds, known = self.model, classes(text).tolist(), self.vocabulary
        # best[j]: cheapest words of text[:j], and where the last one begins; new: cheapest
        # unfinished new word by its letters so far (one, two, more), with its beginning
        best, none = [(0.0, 0)], (math.inf, 0)
        new = [none, none, none]
        for j in range(1, len(text) + 1):
            k = kinds[j - 1]
            b = kinds[j - 2] if j > 1 else 0
            a = kinds[j - 3] if j > 2 else 0
            one = (best[j - 1][0] + NEW_WORD - logp[0, 0, k], j - 1)
            two = (new[0][0] - logp[0, b, k], new[0][1])
            more = min(new[1], new[2])
            new = [one, two, (more[0] - logp[a, b, k], more[1])]
            ends = [(one[0] - logp[0, k, 0], one[1]), *((c - logp[b, k, 0], i) for c, i in new[1:])]
            for i in range(max(0, j - self.longest), j):
                cost = known.get(text[i:j])
                if cost is not None:
                    ends.append((best[i][0] + cost, i))
            best.append(min(ends))
        words, j = [], len(text)
        while j:
            i = best[j][1]
            words.append(text[i:j])
            j = i
        return words[::-1]

    def lattice(self, token: str) -> Iterator[list[tuple[str, list[int], float]]]:
        """For each run of one sign, what it may stand for, its classes and its cost."""
        if len(self.slots) > self.room:
            self.slots.clear()
        for run in re.finditer(r"(.)\1*", token, re.S):
            key = run[1], min(run.end() - run.start(), 3)  # longer runs are as three
            slot = self.slots.get(key)
            if slot is None:
                slot = self.slots[key] = [(out, classes(out).tolist() if out else [], cost)
                                          for out, cost in self._slot(*key)]
            yield slot

    def _slot(self, c: str, n: int) -> list[tuple[str, float]]:
        if c in " .-_*":
            return [("", DROP)]
        letters = [(x, SWAP) for x in LEET.get(c, "")] + [(c, 0.0 if c.isalpha() else LITERAL)]
        lengths = {1: 0.0} if n == 1 else {1: SHORTEN * (n > 2) + 0.4 * (n == 2), 2: 0.0 if n == 2 else SHORTEN}
        return [(x * k, cost * min(n, 2) + more) for x, cost in letters for k, more in lengths.items()]

    def _decode(self, token: str) -> str:
        """The cheapest path; equal costs go to the alphabetically first text. A path is a
        chain of back pointers, which paths share up to where they part: time and memory
        are linear in the token."""
        logp, states = self.model, {(0, 0): (0.0, None)}
        for slot in self.lattice(token):
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                for out, kinds, price in slot:
                    x, y, c = a, b, cost + price
                    for k in kinds:
                        c -= logp[x, y, k]
                        x, y = y, k
                    best = after.get((x, y))
                    if best is None or c < best[0] or c == best[0] and _before((path, out), best[1]):
                        after[x, y] = (c, (path, out))
            states = after
        ends = [(c - logp[a, b, 0], path) for (a, b), (c, path) in states.items()]
        cost, path = ends[0]
        for c, other in ends[1:]:
            if c < cost or c == cost and _before(other, path):
                cost, path = c, other
        return _spelled(path)


def _spelled(path: tuple | None, until: tuple | None = None) -> str:
    parts = []
    while path is not until:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))


def _before(one: tuple | None, other: tuple | None) -> bool:
    """Whether the text of a path is alphabetically before that of another as long."""
    p, q = one, other
    while p is not q:
        p, q = p[0], q[0]
    return _spelled(one, p) < _spelled(other, p)


def spell_out(token: str, decode: Decoder) -> list[str]:
    """Words of a lower-cased token, decoded if it looks disguised: signs among letters,
    three equal letters in a row, or separated single characters."""
    token = TRAIL.sub("", token).strip(".,;:?()[]{}\"'").rstrip("!")
    if HIDDEN.search(token) and WORDS.search(token) or REPEATED.search(token) or DOTTED.match(token):
        token = decode(token)
    return WORDS.findall(token)


def tokens(text: str, decode: Decoder) -> list[str]:
    """Lower-cased tokens; a row of single characters is decoded into its words."""
    text = text.lower()
    if SPACED.search(text):
        text = SPACED.sub(lambda m: decode(m[0]), text)
    return text.split()


def restore(text: str, decode: Decoder) -> list[str]:
    """The words of a text with disguised ones spelled out."""
    return [w for t in tokens(text, decode) for w in spell_out(t, decode)]


# --- classifier --------------------------------------------------------------------------------

def entries(word: str) -> Iterator[str]:
    """A word, and its beginnings marked by a trailing ``-``."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "-"


@dataclass
class ToxicityModel:
    language: np.ndarray
    weights: dict[str, tuple[int, float]]
    dense: tuple[float, float, float]  # of hit share, of log hits, intercept
    vocabulary: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.decode = Decoder(self.language, self.vocabulary)
        self.known: dict[str, tuple[str, ...]] = {}

    def hits(self, text: str | None) -> tuple[dict[str, int], float, float]:
        """Lexicon entries of a text with counts, share of hit words, log of hits."""
        found: dict[str, int] = {}
        hit = 0
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        all_tokens = tokens(text, self.decode) if text else []
        n = len(all_tokens)
        for token in all_tokens:
            own = known.get(token)
            if own is None:
                own = tuple(e for w in spell_out(token, self.decode) for e in entries(w) if e in self.weights)
                if len(token) <= MEMO_CHARS:
                    known[token] = own
            if own:
                hit += 1
                for e in own:
                    found[e] = found.get(e, 0) + 1
        return found, 100.0 * hit / (n + 20), math.log1p(hit)

    def score(self, text: str | None) -> float:
        found, share, log_hits = self.hits(text)
        z = self.dense[2] + self.dense[0] * share + self.dense[1] * log_hits
        z += sum(self.weights[e][1] for e in found)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _entry_counts(rows: DataFrame, language: np.ndarray, vocabulary: dict[str, float]) -> DataFrame:
    """``(entry, clean, toxic)``: rows of each class that hold the entry."""
    shared = rows.sparkSession.sparkContext.broadcast((language, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, seen = Decoder(*shared.value), {}
        for batch in batches:
            for text, y in zip(column(batch, "text"), column(batch, "y")):
                words = set(restore(text, decode)) if text else ()
                for e in {e for w in words for e in entries(w)}:
                    seen.setdefault(e, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
             pa.array([v[1] for v in seen.values()], pa.int64())], names=["entry", "clean", "toxic"])

    return rows.mapInArrow(count, "entry string, clean bigint, toxic bigint").groupBy("entry").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Language model over all documents; lexicon and weights from at most
    ``train_rows`` labelled rows (those of the smallest hash of their id).

    Ids with a null or with differing labels are not learned from. Without labelled
    rows of both classes every text scores the share of toxic rows (0.5 if none).
    """
    spark = docs.sparkSession
    language = language_model(docs, text_col)
    agreed = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(label_col).alias("y"), F.max(label_col).alias("top")).filter("y = top").drop("top")
    # at most train_rows pairs of an id and a label, so the documents are not shuffled
    chosen = F.broadcast(materialize(sample_ids(agreed, id_col, train_rows)))
    rows = materialize(docs.select(F.col(id_col), F.col(text_col).alias("text")).join(chosen, id_col)
                       .select("text", F.col("y").cast("int").alias("y")))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        p = (n1 + 1) / (n0 + n1 + 2)
        return ToxicityModel(language, {}, (0.0, 0.0, math.log(p / (1 - p))))
    counts = _entry_counts(rows, language, {})
    # what may be an entry comes first, so that no row is split within it
    words = counts.filter("entry not like '%-' and clean + toxic > 1").orderBy(
        F.desc(F.col("toxic") >= MIN_TOXIC), F.desc(F.col("clean") + F.col("toxic")), "entry").limit(VOCABULARY)
    seen = {r["entry"]: r["clean"] + r["toxic"] for r in words.collect()}
    total = sum(seen.values())
    vocabulary = {w: math.log(total / n) for w, n in seen.items()}
    counts = _entry_counts(rows, language, vocabulary)
    # log odds, shrunk by their standard error
    c, t = F.col("clean") + 0.5, F.col("toxic") + 0.5
    odds = F.log(t / (n1 + 1 - t)) - F.log(c / (n0 + 1 - c)) - 2 * F.sqrt(1 / t + 1 / c)
    top = counts.filter(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds).filter("odds > 1")
    lexicon = [r["entry"] for r in top.orderBy(F.desc("odds"), "entry").limit(features).collect()]
    model = ToxicityModel(language, {e: (i, 0.0) for i, e in enumerate(sorted(lexicon))}, (0.0, 0.0, 0.0), vocabulary)
    ready = spark.sparkContext.broadcast(model)
    size = len(model.weights) + 2

    def vectors(batch: pa.RecordBatch):
        at, own = [], ready.value
        for text in column(batch, "text"):
            found, share, log_hits = own.hits(text)
            at.append({**{own.weights[e][0]: 1.0 for e in found}, size - 2: share, size - 1: log_hits})
        yield {"y": array(batch, "y").cast(pa.float64()), "i": [sorted(x) for x in at],
               "v": [[x[k] for k in sorted(x)] for x in at]}

    sparse = F.udf(lambda i, v: Vectors.sparse(size, i, v), Vectors.sparse(1, []).__UDT__)
    points = materialize(map_rows(rows, vectors, "y double, i array<int>, v array<double>").select(
        F.col("y").alias("label"), sparse("i", "v").alias("features")))
    fitted = LogisticRegression(regParam=0.002, elasticNetParam=0.0, maxIter=60, standardization=True).fit(points)
    w = fitted.coefficients.toArray()
    return ToxicityModel(language, {e: (i, float(w[i])) for e, (i, _) in model.weights.items()},
                         (float(w[size - 2]), float(w[size - 1]), float(fitted.intercept)), vocabulary)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = (),
                   score: str = "score") -> DataFrame:
    """The columns ``keep`` and, under the name ``score``, the score of every row: the whole
    text is scored, null and empty ones like a text without words; an empty table gives
    an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = {f"keep_{i}": c for i, c in enumerate(keep)}
    # a text that is kept is not sent to the tasks a second time
    text = next((k for k, c in columns.items() if c == text_col), "text")
    rows = docs.select(*(F.col(c).alias(k) for k, c in columns.items()),
                       *([F.col(text_col).alias("text")] if text == "text" else []))
    head = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in columns.items())

    def run(batch: pa.RecordBatch):
        own = shared.value
        yield {**{k: array(batch, k) for k in columns}, "score": [own.score(t) for t in column(batch, text)]}

    return map_rows(rows, run, f"{head}score double").select(
        *(F.col(k).alias(c) for k, c in columns.items()), F.col("score").alias(score))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold: crc32 of the id modulo 3 is not 1."""
    return labels.filter(fold_of(id_col, 3) != 1)
