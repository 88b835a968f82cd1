"""SentencePiece encoding and decoding as a max-plus scan over piece lattices.

The public models at hand are byte-pair models, for which the sum of piece scores is
not what encoding maximises. The weights here make the scan exact for them: an arc of
the lattice is a piece, and the weight of two arcs that follow one another is 0 if
merging the text of both gives exactly these two pieces, else minus infinity. A path is
the model's encoding if and only if all its neighbours have weight 0: a merge across a
border would have happened in the text of the two pieces alone as well, as merges go by
rank, then from the left. So every prefix has one finite path, the maximum of a state is
reached by one predecessor, and matrices need to list their finite cells only.
"""

from __future__ import annotations

import re
from array import array as ints
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import array, column, map_rows

BLANK = "▁"
CHUNK = 16_384        # characters; longer texts are encoded in chunks
MEMO = 150_000        # words a task remembers, and as many of those before them
MEMO_CHARS = 64       # longer words are encoded each time they occur
PAIRS = 400_000       # pairs of neighbours a task remembers
State = tuple[int, int]  # an arc at a border: characters before it, characters behind it
Matrix = dict[State, frozenset]


@dataclass
class Pieces:
    """The vocabulary of a byte-pair model with byte fallback and no normalisation."""

    rank: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    texts: list[bytes]
    prefix: bool
    longest: int = 0
    joined: frozenset = frozenset()
    words: re.Pattern | None = None
    room: int = MEMO
    memo: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[str, dict[str, bool]] = field(default_factory=dict)
    n_pairs: int = 0
    halves: dict[str, tuple[str, str] | None] = field(default_factory=dict)
    tree: dict[str, list] = field(default_factory=dict)  # character -> [piece or None, tree]
    apart: bool = False

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.rank), default=1)
        for p in self.rank:
            tree = self.tree
            for c in p:
                node = tree.setdefault(c, [None, {}])
                tree = node[1]
            node[0] = p
        self.joined = frozenset(p[i:i + 2] for p in self.rank for i in range(len(p) - 1))
        # between two characters that no piece joins, encodings do not depend on one
        # another: at blanks that follow another sign, and around line breaks
        self.apart = not any(p[1] == BLANK and p[0] != BLANK or "\n" in p for p in self.joined)
        self.words = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if self.apart else "(?s:.+)")

    def escape(self, text: str) -> str:
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK) if text else ""

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging by rank, then from the left: the definition."""
        parts = list(text)
        while (i := self._best(parts)) is not None:
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two halves whose merge completes a piece; null for a single character and
        for a piece that merging its own text does not give."""
        known = self.halves.get(piece, 0)
        if known == 0:
            parts, known = list(piece), None
            while len(parts) > 1:
                best = self._best(parts)
                if best is None:
                    known = None
                    break
                known = tuple(parts[best:best + 2])
                parts[best:best + 2] = ["".join(known)]
            self.halves[piece] = known
        return known

    def _best(self, parts: list[str]) -> int | None:
        """Where merging goes on: at the best rank, the leftmost of equals."""
        rank = self.rank
        found = [(rank[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in rank]
        return -max(found)[1] if found else None

    def alone(self, piece: str) -> bool:
        return len(piece) == 1 or self.last_merge(piece) is not None

    def follows(self, left: str, right: str) -> bool:
        """Whether the weight of the two arcs is 0 (with no ``left``: whether the text of
        ``right`` is encoded as this one piece)."""
        row = self.pairs.get(left)
        if row is None:
            row = self.pairs[left] = {}
        known = row.get(right)
        if known is None:
            if not left:
                known = self.alone(right)
            elif not (self.alone(left) and self.alone(right)):
                known = False
            elif left[-1] + right[0] not in self.joined:
                known = True
            elif left[-1] == right[0] == BLANK:  # runs of blanks have equal ranks
                known = self.merge(left + right) == [left, right]
            else:
                known = self._apart(left, right)
            if self.n_pairs >= PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
                row = self.pairs[left] = {}
            row[right] = known
            self.n_pairs += 1
        return known

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge of the two pieces' text crosses their border.

        Takes the merges inside the pieces back, the latest first. In between, the parts
        at the border lie next to one another; had a merge of them a better rank than the
        one taken back last, it would have come before it.
        """
        rank, least, side = self.rank, float("-inf"), 0
        ends = [left, right]
        while True:
            cross = rank.get(ends[0] + ends[1])
            if cross is not None and (cross > least or side and cross == least):
                return False
            halves = [self.last_merge(e) if len(e) > 1 else None for e in ends]
            if not any(halves):
                return True
            # of two possible ones the later merge is that of the lower rank; of equal
            # ranks the right one, as merges go from the left
            side = 1 if halves[0] is None or (halves[1] and rank[ends[1]] <= rank[ends[0]]) else 0
            least = rank[ends[side]]
            ends[side] = halves[side][1 - side]

    def forward(self, s: str, at: int, since: int, stop: int, starts: int) -> dict[int, int]:
        """For each border up to ``stop`` that a path reaches, where its last arc starts.

        Paths begin at ``at`` behind the arc ``s[since:at]`` (none if equal); only arcs
        that start before ``starts`` are used. The maximum over predecessors is the
        first finite one, as there is at most one.
        """
        last, rank, follows, longest = {at: since}, self.rank, self.follows, self.longest
        for end in range(at + 1, stop + 1):
            for start in range(max(at, end - longest), min(end, starts)):
                before = last.get(start)
                if before is None:
                    continue
                piece = s[start:end]
                if (end - start == 1 or piece in rank) and follows(s[before:start], piece):
                    last[end] = start
                    break
        return last

    def path(self, s: str, last: dict[int, int], end: int, at: int) -> list[str]:
        """Backtrace from ``end`` to ``at``."""
        out = []
        while end > at:
            out.append(s[last[end]:end])
            end = last[end]
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> bytes:
        ids = self.ids
        try:
            return ints("i", [ids[p] for p in pieces]).tobytes()
        except KeyError:  # a character outside the vocabulary goes by its bytes
            found = [[ids[p]] if p in ids else [self.byte_ids[b] for b in p.encode("utf-8", "replace")] for p in pieces]
            return ints("i", [i for x in found for i in x]).tobytes()

    def one_path(self, s: str) -> list[str]:
        """The finite path over a stretch, searched depth first, longest arcs first.

        No border is reached twice: its path from the begin is unique. So this visits
        borders that ``forward`` visits as well, but mostly only those of the result.
        """
        pairs, follows, tree, longest, n = self.pairs, self.follows, self.tree, self.longest, len(s)
        path: list[str] = [""]
        starts, tries = [0], []
        start, fresh = 0, True
        while start < n:
            if fresh:  # pieces at this border, the longest last; an unknown character is one
                arcs, children = [], tree
                for c in s[start:start + longest]:
                    node = children.get(c)
                    if node is None:
                        break
                    piece, children = node
                    if piece is not None:
                        arcs.append(piece)
                if not arcs or len(arcs[0]) > 1:
                    arcs.insert(0, s[start])
                tries.append(arcs)
            left, arcs = path[-1], tries[-1]
            row = pairs.get(left)
            fresh = False
            while arcs:
                piece = arcs.pop()
                ok = row.get(piece) if row is not None else None
                if ok or ok is None and follows(left, piece):
                    start += len(piece)
                    starts.append(start)
                    path.append(piece)
                    fresh = True
                    break
            else:
                tries.pop()
                starts.pop()
                path.pop()
                start = starts[-1]
        return path[1:]

    def word(self, word: str) -> bytes:
        """Ids of a stretch that no piece joins with its neighbours, as int32.

        What is remembered comes in two generations: when the younger one is full it
        becomes the older, and what is looked up there moves up again.
        """
        found = self.older.get(word)
        if found is None:
            found = self.to_ids(self.one_path(word))
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= self.room:
                # in place: callers hold on to the younger generation
                self.older = dict(self.memo)
                self.memo.clear()
            self.memo[word] = found
        return found

    def stretch(self, s: str) -> bytes:
        word, memo = self.word, self.memo
        return b"".join([memo.get(w) or word(w) for w in self.words.findall(s)])

    def text(self, text: str) -> bytes:
        """Ids of a whole text; where blanks and line breaks stand alone, words are found
        by splitting, else as ``stretch`` does."""
        if not text:
            return b""
        if not (self.apart and self.prefix) or BLANK in text:
            return self.stretch(self.escape(text))
        word, memo, out = self.word, self.memo, []
        for k, line in enumerate(text.split("\n")):
            mark = "" if k else BLANK
            if k:
                out.append(memo.get("\n") or word("\n"))
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                out.append(self.stretch(mark + line.replace(" ", BLANK)))
            elif line or mark:
                out += [memo.get(w) or word(w) for w in (mark + line.replace(" ", " " + BLANK)).split(" ")]
        return b"".join(out)

    def covers(self, ids: bytes, s: str) -> bool:
        """Whether the ids' own bytes are those of an escaped stretch."""
        found = b"".join([self.texts[i] for i in np.frombuffer(ids, dtype=np.int32).tolist()])
        return found == s.replace(BLANK, " ").encode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, ids beyond the model are
        skipped."""
        n = len(self.texts)
        text = b"".join([self.texts[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load_pieces(path: str, room: int = MEMO) -> Pieces:
    """Read a model file on the driver; tasks get it by broadcast (its size is that of a
    vocabulary, not of data). ``room`` is the number of words a task remembers."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        model = proto.ModelProto.FromString(file.read())
    norm, kinds = model.normalizer_spec, [p.type for p in model.pieces]
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or \
            not norm.escape_whitespaces or kinds.count(6) != 256 or 4 in kinds:
        raise ValueError("only byte-pair models with byte fallback and identity normalisation are supported")
    plain = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type == 1]
    byte_ids = [i for i, k in enumerate(kinds) if k == 6]
    texts = [p.piece.replace(BLANK, " ").encode() if p.type == 1 else
             bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" for p in model.pieces]
    return Pieces({p: s for p, s, _ in plain}, {p: i for p, _, i in plain}, byte_ids, texts, norm.add_dummy_prefix,
                  room=room)


# --- chunks of a long text ---------------------------------------------------------------------

@dataclass
class Part:
    """Characters ``[a, b)`` of a chunk inside ``s``, with a piece's length around it."""

    s: str
    a: int
    b: int
    final: bool


def parts(s: str, chunk: int, margin: int) -> Iterator[Part]:
    for a in range(0, max(1, len(s)), chunk):
        b = min(a + chunk, len(s))
        low, high = max(0, a - margin), min(len(s), b + margin)
        yield Part(s[low:high], a - low, b - low, b == len(s))


def _cuts(pieces: Pieces, part: Part) -> tuple[int, int] | None:
    """First and last border in ``[a, b)`` that no piece can cross."""
    s, a, b = part.s, part.a, part.b
    free = lambda p: p == 0 or s[p - 1:p + 1] not in pieces.joined
    first = next((p for p in range(a, b) if free(p)), None)
    return None if first is None else (first, next(p for p in range(b - 1, a - 1, -1) if free(p)))


def _exits(pieces: Pieces, part: Part, last: dict[int, int]) -> frozenset:
    """States at the end: arcs that start before it and reach it."""
    b, ends = part.b, range(part.b, part.b + (0 if part.final else pieces.longest) + 1)
    return frozenset((b - last[e], e - b) for e in ends if e in last and last[e] < b)


def _last_end(pieces: Pieces, part: Part) -> int:
    return part.b if part.final else min(len(part.s), part.b + pieces.longest)


def transfer(pieces: Pieces, part: Part) -> Matrix:
    """Finite cells of the chunk's matrix: for each state at its begin, those at its end."""
    s, a, b = part.s, part.a, part.b
    if a == 0:
        entries = [(0, 0)]
    else:
        entries = [(a - st, en - a) for st in range(max(0, a - pieces.longest), a)
                   for en in range(a, min(len(s), st + pieces.longest) + 1)
                   if en - st == 1 or s[st:en] in pieces.rank]
    cuts = _cuts(pieces, part)
    stop = _last_end(pieces, part)
    out: Matrix = {}
    if cuts:  # all paths meet at the first cut, so rows are equal where they are finite
        ends = _exits(pieces, part, pieces.forward(s, cuts[1], cuts[1], stop, b))
        for back, ahead in entries:
            if a + ahead <= cuts[0] and cuts[0] in pieces.forward(s, a + ahead, a - back, cuts[0], b):
                out[back, ahead] = ends
        return out
    for back, ahead in entries:
        if a + ahead >= b:  # the arc covers the chunk
            if a + ahead == b or not part.final:
                out[back, ahead] = frozenset({(back + b - a, a + ahead - b)})
            continue
        ends = _exits(pieces, part, pieces.forward(s, a + ahead, a - back, stop, b))
        if ends:
            out[back, ahead] = ends
    return out


def compose(left: Matrix, right: Matrix) -> Matrix:
    """Max-plus product of matrices with cells 0 and minus infinity; associative."""
    out = {}
    for state, mids in left.items():
        ends = frozenset().union(*(right.get(m, frozenset()) for m in mids))
        if ends:
            out[state] = ends
    return out


def borders(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """(begin, end) state of every chunk on the one finite path from the begin of the
    text to its end, from the prefix products."""
    reached = [m.get((0, 0), frozenset()) for m in accumulate(matrices, compose)]
    (end,) = [s for s in reached[-1] if s[1] == 0]
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        before = reached[k - 1] if k else frozenset({(0, 0)})
        (begin,) = [s for s in before if end in matrices[k].get(s, ())]
        out.append((begin, end))
        end = begin
    return out[::-1]


def backtrace(pieces: Pieces, part: Part, begin: State, end: State) -> bytes:
    """Ids of the arcs that start in the chunk, given its border states."""
    s, a, b = part.s, part.a, part.b
    at, since = a + begin[1], a - begin[0]
    to, stop = b + end[1], _last_end(pieces, part)
    if at >= b:
        return b""
    cuts = _cuts(pieces, part)
    if not cuts:
        return pieces.to_ids(pieces.path(s, pieces.forward(s, at, since, stop, b), to, at))
    head = pieces.path(s, pieces.forward(s, at, since, cuts[0], b), cuts[0], at)
    tail = pieces.path(s, pieces.forward(s, cuts[1], cuts[1], stop, b), to, cuts[1])
    return pieces.to_ids(head) + pieces.stretch(s[cuts[0]:cuts[1]]) + pieces.to_ids(tail)


# --- Spark ---------------------------------------------------------------------------------------

def _ids_array(found: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))


def _same(pieces: Pieces, text: str, ids: bytes) -> bool:
    return pieces.decode(np.frombuffer(ids, dtype=np.int32).tolist()) == text.replace(BLANK, " ")


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """``id_col``, the columns ``keep``, ``token_ids`` and ``round_trip`` for every row.

    The ids are those of the model's own encoder. ``round_trip`` tells whether decoding
    gives the text back (U+2581 itself comes back as a blank). Null and empty texts have
    no ids and come back empty; repeated rows stay repeated; an empty table gives an
    empty one. Texts of over ``chunk`` characters are cut into chunks in rows of their
    own: each yields its transfer matrix, the matrices of a text are combined (a few
    states a chunk), and each chunk is backtraced by itself.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)),
                       F.col(text_col).alias("text"))
    kept = [f for f in rows.schema.fields if f.name.startswith("keep_")]
    head = "id bigint, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    names = ["id", *(f.name for f in kept)]
    long = F.coalesce(F.length("text") > chunk, F.lit(False))

    def short(batch: pa.RecordBatch):
        own = shared.value
        texts = [t or "" for t in column(batch, "text")]
        found = [own.text(t) for t in texts]
        yield {**{n: array(batch, n) for n in names}, "token_ids": _ids_array(found),
               "round_trip": [_same(own, t, f) for t, f in zip(texts, found)]}

    out = "token_ids array<int>, round_trip boolean"
    encoded = map_rows(rows.filter(~long), short, head + out)
    giants = rows.filter(long).withColumn("key", F.monotonically_increasing_id())
    encoded = encoded.unionByName(_encode_long(giants, shared, names, head, chunk))
    return encoded.select(F.col("id").alias(id_col), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)),
                          "token_ids", "round_trip")


PART = "key bigint, k int, s string, a int, b int, final boolean"


def _encode_long(giants: DataFrame, shared, names: list[str], head: str, chunk: int) -> DataFrame:
    spark = giants.sparkSession

    def split(batch: pa.RecordBatch):
        own = shared.value
        # the columns that are kept go with the first chunk only
        others = iter([dict(zip(names, row)) for row in zip(*(column(batch, n) for n in names))])
        for key, text in zip(column(batch, "key"), column(batch, "text")):
            found = list(parts(own.escape(text), chunk, own.longest))
            yield {"key": [key] * len(found), "k": list(range(len(found))), "s": [p.s for p in found],
                   "a": [p.a for p in found], "b": [p.b for p in found], "final": [p.final for p in found],
                   **{n: [v] + [None] * (len(found) - 1) for n, v in next(others).items()}}

    def part_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        cols = [column(batch, n) for n in ("s", "a", "b", "final")]
        return (Part(*x) for x in zip(*cols))

    def matrix(batch: pa.RecordBatch):
        own = shared.value
        cells = [[(i, j, p, q) for (i, j), ends in transfer(own, part).items() for p, q in ends]
                 for part in part_rows(batch)]
        yield {"key": array(batch, "key"), "k": array(batch, "k"),
               "cells": [[dict(zip("ijpq", c)) for c in row] for row in cells]}

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        matrices = []
        for cells in group.cells:
            found: dict[State, set] = {}
            for c in cells:
                found.setdefault((c["i"], c["j"]), set()).add((c["p"], c["q"]))
            matrices.append({s: frozenset(e) for s, e in found.items()})
        states = borders(matrices)
        return pd.DataFrame({"key": group.key.to_numpy(), "k": group.k.to_numpy(),
                             "states": [[*begin, *end] for begin, end in states]})

    def finish(batch: pa.RecordBatch):
        own = shared.value
        found, same = [], []
        for part, x in zip(part_rows(batch), column(batch, "states")):
            found.append(backtrace(own, part, (x[0], x[1]), (x[2], x[3])))
            same.append(own.covers(found[-1], part.s[part.a + x[1]:part.b + x[3]]))
        yield {"key": array(batch, "key"), "k": array(batch, "k"), "part": _ids_array(found), "same": same,
               **{n: array(batch, n) for n in names}}

    rows = map_rows(giants, split, head + PART)
    chunks = materialize(rows)
    cells = map_rows(chunks.select("key", "k", "s", "a", "b", "final"), matrix,
                     "key bigint, k int, cells array<struct<i:int,j:int,p:int,q:int>>")
    # numbered parts: adaptive execution would merge these small rows into a task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    states = cells.repartition(tasks, "key").groupBy("key").applyInPandas(combine, "key bigint, k int, states array<int>")
    traced = map_rows(chunks.join(states, ["key", "k"]), finish, f"{head}key bigint, k int, part array<int>, same boolean")
    return traced.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("k", "part"))).alias("all"), F.every("same").alias("round_trip"),
        *(F.max_by(n, -F.col("k")).alias(n) for n in names),
    ).select(*names, F.flatten("all.part").alias("token_ids"), "round_trip")


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "token_ids", id_col: str = "doc_id") -> DataFrame:
    """``(id_col, text)`` of id arrays; null arrays give null, empty ones an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batch: pa.RecordBatch):
        yield {"id": array(batch, "id"), "text": [
            None if x is None else shared.value.decode([i for i in x if i is not None])
            for x in column(batch, "ids")]}

    cut = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_rows(cut, run, "id bigint, text string").withColumnRenamed("id", id_col)
