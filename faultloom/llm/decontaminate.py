"""Benchmark decontamination with a generalised suffix automaton over item words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import array, column, map_rows

WINDOW = 10
BLOCK = 64 << 20  # bytes of item texts that one automaton holds
# bytes that belong to words after lower-casing A-Z; all others become a blank
_BLANK = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; null has none."""
    return text.translate(_BLANK).split() if text else []


class SuffixAutomaton:
    """All word runs of all items, as a minimal automaton.

    ``items[state]`` lists the items whose window of ``window`` words is the run of
    that length in the state; ``short[state]`` holds (length, items) of whole items of
    fewer words that end a run of the state, its suffix links included. Size is linear
    in the words of the items.
    """

    def __init__(self, texts: dict[int, list[bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.anchor: list[int] = []
        self.items: dict[int, tuple[int, ...]] = {}
        self.short: dict[int, tuple[tuple[int, tuple[int, ...]], ...]] = {}
        for run in texts.values():
            last = 0
            for word in run:
                last = self._extend(last, word)
        self._mark(texts)

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            there = self.next[at][word]
            same = self.length[there] == self.length[at] + 1
            self.link[new] = there if same else self._clone(at, word, there)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, at: int, word: bytes, there: int) -> int:
        """The shorter runs of ``there`` get a state of their own."""
        copy = self._state(self.length[at] + 1)
        self.next[copy] = dict(self.next[there])
        self.link[copy] = self.link[there]
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _mark(self, texts: dict[int, list[bytes]]) -> None:
        full: dict[int, set[int]] = {}
        whole: dict[int, tuple[int, set[int]]] = {}
        anchor = self._anchors()
        for item, run in texts.items():
            state = 0
            for i, word in enumerate(run, 1):
                state = self.next[state][word]
                if i >= self.window:
                    full.setdefault(anchor[state], set()).add(item)
            if 0 < len(run) < self.window:
                whole.setdefault(state, (len(run), set()))[1].add(item)
        self.items = {s: tuple(sorted(x)) for s, x in full.items()}
        self.anchor = anchor
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            ends = self.short.get(self.link[state], ()) if state else ()
            if state in whole:
                n, found = whole[state]
                ends = (*ends, (n, tuple(sorted(found))))
            if ends:
                self.short[state] = ends

    def _anchors(self) -> list[int]:
        """For each state, the state of its suffix of ``window`` words, else -1."""
        anchor = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= self.window:
                up = self.link[s]
                anchor[s] = s if self.length[up] < self.window else anchor[up]
        return anchor

    def scan(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals ``[from, to)`` inside occurrences, merged, and the items."""
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        nexts, link, length, window = self.next, self.link, self.length, self.window
        root, anchor, short, full = nexts[0], self.anchor, self.short, self.items
        state = matched = 0
        for i, word in enumerate(run):
            to = nexts[state].get(word)
            if to is None:
                if word not in root:
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = nexts[state].get(word)
                matched = length[state] + 1
            else:
                matched += 1
            state = to
            if matched >= window:
                hits.append((i + 1 - matched, i + 1))
                items.update(full[anchor[state]])
            if state in short:
                for n, found in short[state]:
                    if n <= matched:
                        hits.append((i + 1 - n, i + 1))
                        items.update(found)
        return merge(hits), items


def merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> list[DataFrame]:
    """The items in blocks of about ``max_bytes`` of text, so that what is collected and
    broadcast at once does not grow with the benchmark."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.filter("id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // max_bytes))
    return [rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def _automaton(block: DataFrame, window: int) -> tuple[SuffixAutomaton, dict[int, int]]:
    """Automaton of a block, and the item id of each of its texts."""
    texts = [(item, words(bytes(text))) for item, text in block.toLocalIterator()]
    return SuffixAutomaton({i: run for i, (_, run) in enumerate(texts)}, window), {
        i: item for i, (item, _) in enumerate(texts)}


SCAN = "n_words bigint, hits array<struct<from:int,to:int>>, items array<bigint>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       keep: tuple[str, ...] = (), max_bytes: int = BLOCK) -> DataFrame:
    """One row per document: id, the columns ``keep``, ``n_words``, hit word intervals
    ``[from, to)`` and the items with occurring windows, sorted.

    Null and empty texts have no words and no hits; items without words never occur;
    rows with a null item id are ignored; items of one id count as one; an empty
    benchmark leaves all documents clean. No shuffle: documents stream past a broadcast
    automaton. A benchmark of over ``max_bytes`` is taken in blocks, one pass each.
    """
    found = _scan(docs, benchmark, id_col, text_col, item_col, item_text_col, window, keep, max_bytes)
    first = [] if id_col in keep else [F.col("id").alias(id_col)]
    return found.select(*first, *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)),
                        "n_words", "hits", "items")


def _scan(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
          window: int, keep: tuple[str, ...], max_bytes: int) -> DataFrame:
    """``id``, the columns ``keep`` as ``keep_0`` and so on, and what was found."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                       *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    kept = [f for f in rows.schema.fields if f.name.startswith("keep_")]
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    result = None
    blocks = _blocks(benchmark, item_col, item_text_col, max_bytes)
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(_automaton(block, window))
        if result is not None:  # a further block goes over what the last one found
            result = materialize(result)
        more = k + 1 < len(blocks)

        def scan(batch: pa.RecordBatch, shared=shared, first=result is None, more=more):
            auto, named = shared.value
            n_words, hits, items = [], [], []
            before = None if first else (column(batch, "hits"), column(batch, "items"))
            for i, text in enumerate(column(batch, "text")):
                run = words(text)
                got, found = auto.scan(run) if run else ([], set())
                ids = {named[x] for x in found}
                if before:
                    got = merge(got + [(h["from"], h["to"]) for h in before[0][i]])
                    ids |= set(before[1][i])
                n_words.append(len(run))
                hits.append([{"from": a, "to": b} for a, b in got])
                items.append(sorted(ids))
            yield {"id": array(batch, "id"), "n_words": n_words, "hits": hits, "items": items,
                   **({"text": array(batch, "text")} if more else {}),
                   **{f.name: array(batch, f.name) for f in kept}}

        result = map_rows(rows if result is None else result, scan,
                          f"id bigint, {'text binary, ' if more else ''}{head}{SCAN}")
    return result


def cut_spans(text: str, hits: list[dict], min_words: int = 1) -> str:
    """The text without the word intervals of at least ``min_words`` words."""
    data = text.encode()
    starts = [m.span() for m in WORD.finditer(data.translate(_BLANK))]
    out, at = [], 0
    for hit in hits:
        if hit["to"] - hit["from"] >= min_words:
            out.append(data[at:starts[hit["from"]][0]])
            at = starts[hit["to"] - 1][1]
    out.append(data[at:])
    return b"".join(out).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                         max_coverage: float = 0.5, min_words: int = 1, window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, without benchmark passages.

    Hit intervals of ``min_words`` or more words are cut out of the text; a document
    with over ``max_coverage`` of its words hit is dropped. Documents without hits,
    nulls included, come out as they were.
    """
    names = docs.columns
    found = _scan(docs, benchmark, id_col, text_col, "item_id", "text", window, tuple(names), BLOCK)
    share = F.expr("aggregate(hits, 0L, (n, h) -> n + h.to - h.from)") / F.col("n_words")
    left = found.filter((F.col("n_words") == 0) | (share <= max_coverage))
    at = names.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut_spans(t, h, min_words) if h else t for t, h in zip(batch.column(at).to_pylist(), hits)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return left.select(*(f"keep_{i}" for i in range(len(names))), "hits").mapInArrow(clean, docs.schema)
