"""Skip-gram vectors of characters, trained on counts of neighbouring characters.

Skip-gram with hierarchical softmax sees a text only through its pairs of a character and
a neighbour, and there are few different pairs however long the text is. So the pairs of
all texts are counted once, and every step of the training uses all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = 1000  # known characters; no pair crosses from one such run to the next
LEARNING_RATE = 0.025
STEPS_A_PASS = 60
MAX_EXP = 6.0  # pairs that are predicted more surely than this are left alone

# A step of a row is LEARNING_RATE times the sum over its pairs. With many pairs that
# overshoots, so it is no longer than these multiples of the mean and of the inverse curvature.
_MEAN_STEP, _CURVATURE_STEP = 16.0, 8.0

_EMPTY = 0x110000  # an empty text splits into one empty character
_PIECE = 1 << 20  # characters counted at a time
_DENSE = 1 << 20  # most pairs of characters that a task counts in one array
_CELLS = 1 << 16  # most rows of the training table in a block


def _codes(text: bytes | None) -> np.ndarray:
    """The code points of a text; null has none."""
    if not text:
        return np.array([] if text is None else [_EMPTY], dtype="<u4")
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def _word(code: int) -> str:
    return "" if code == _EMPTY else chr(code)


def code_of(word: str) -> int:
    return ord(word) if word else _EMPTY


def places(codes: Sequence[int]) -> np.ndarray:
    """From code point to position in the vocabulary, -1 if it is not there."""
    table = np.full(_EMPTY + 1, -1, dtype=np.int64)
    table[np.asarray(codes, dtype=np.int64)] = np.arange(len(codes))
    return table


def known(text: bytes | None, table: np.ndarray) -> np.ndarray:
    """The text's characters as positions in the vocabulary, without unknown ones."""
    found = table[_codes(text)]
    return found[found >= 0]


def _pieces(arrays: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The same values in longer arrays."""
    held, size = [], 0
    for values in arrays:
        held.append(values)
        size += len(values)
        if size >= _PIECE:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        for value in batch.column(0):
            yield value.as_py()


def vocabulary(docs: DataFrame, text_col: str, min_count: int) -> tuple[list[str], list[int]]:
    """The characters that occur ``min_count`` times or more, and their counts; most
    frequent first, ties by code point. At most as many as Unicode has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_EMPTY + 1, dtype=np.int64)
        for piece in _pieces(map(_codes, _values(batches))):
            counts += np.bincount(piece, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["code", "n"]
        )

    rows = (
        _texts(docs, text_col).mapInArrow(run, "code int, n bigint")
        .groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).collect()
    )
    rows.sort(key=lambda r: (-r["n"], r["code"]))
    return [_word(r["code"]) for r in rows], [r["n"] for r in rows]


def huffman_paths(counts: Sequence[int]) -> list[tuple[int, int, int]]:
    """Rows ``word, node, label``: the inner nodes from each word to the root of the
    Huffman tree, with label 1 where the path takes the rarer branch."""
    heap = [(n, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    for node in range(len(counts) - 1):
        (n, rare), (m, other) = heapq.heappop(heap), heapq.heappop(heap)
        above[rare], above[other] = (node, 1), (node, 0)
        heapq.heappush(heap, (n + m, len(counts) + node))
    rows = []
    for word in range(len(counts)):
        at = word
        while at in above:
            node, label = above[at]
            rows.append((word, node, label))
            at = len(counts) + node
    return rows


def pair_counts(docs: DataFrame, text_col: str, codes: Sequence[int], window: int) -> DataFrame:
    """Rows ``context, word, n`` of positions in the vocabulary.

    Skip-gram draws a reach of 1 to ``window`` at every character, so a pair at distance
    d is seen ``window + 1 - d`` times in ``window``; n sums these whole numbers.
    """
    size = len(codes)
    side = size + 1  # the last one is the gap between two runs

    def lines(texts: Iterator[bytes | None], table: np.ndarray) -> Iterator[np.ndarray]:
        gap = np.full(window, size)
        for text in texts:
            found = known(text, table)
            for start in range(0, len(found), SENTENCE):
                yield found[start:start + SENTENCE]
                yield gap

    def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        context, word = np.divmod(keys, side)
        keep = (context < size) & (word < size)
        return pa.RecordBatch.from_arrays(
            [pa.array(context[keep], pa.int32()), pa.array(word[keep], pa.int32()), pa.array(n[keep], pa.int64())],
            names=["context", "word", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side if side * side <= _DENSE else 0, dtype=np.int64)
        for line in _pieces(lines(_values(batches), places(codes))):
            for d in range(1, window + 1):
                keys = line[:-d] * side + line[d:]
                if len(total):
                    total += (window + 1 - d) * np.bincount(keys, minlength=len(total))
                else:
                    keys, n = np.unique(keys, return_counts=True)
                    yield rows(keys, (window + 1 - d) * n)
        if len(total):
            seen = np.flatnonzero(total)
            yield rows(seen, total[seen])

    forward = _texts(docs, text_col).mapInArrow(run, "context int, word int, n bigint")
    forward = forward.groupBy("context", "word").agg(F.sum("n").alias("n"))
    # each of the two is the other's neighbour
    return forward.select(F.inline(F.array(
        F.struct("context", "word", "n"),
        F.struct(F.col("word").alias("context"), F.col("context").alias("word"), "n"),
    )))


def _blocks(pairs: DataFrame, paths: list[tuple[int, int, int]], size: int, window: int, partitions: int) -> RDD:
    """The training table, how often a context met each branch of each inner node, as
    blocks of whole contexts."""
    nodes = pairs.sparkSession.createDataFrame(paths, "word int, node int, label int")
    cells = pairs.join(F.broadcast(nodes), "word").groupBy("context", "node").agg(
        F.sum(F.col("n") * F.col("label")).alias("ones"), F.sum("n").alias("n")
    )
    contexts = max(1, _CELLS // size)  # in a block

    def pack(cells: pa.Table) -> pa.Table:
        cells = cells.sort_by([("context", "ascending"), ("node", "ascending")])
        packed = {"block": pa.array([cells["context"][0].as_py() // contexts])}
        for name in names:
            packed[name] = pa.array([cells[name].to_numpy().astype(np.int64).tobytes()], pa.binary())
        return pa.table(packed)

    def block(row) -> tuple:
        context, node, ones, n = (np.frombuffer(row[name], np.int64) for name in names)
        by_node = np.argsort(node, kind="stable")
        first = [np.flatnonzero(np.diff(x, prepend=-1)) for x in (context, node[by_node])]
        return row["block"], context, node, ones / window, n / window, by_node, *first

    names = ["context", "node", "ones", "n"]
    packed = cells.groupBy(F.floor(F.col("context") / contexts)).applyInArrow(
        pack, ", ".join(["block bigint", *(f"{name} binary" for name in names)])
    )
    tasks = min(partitions, -(-size // contexts))
    return packed.repartition(tasks).rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def _slopes(blocks: Iterator[tuple], left: np.ndarray, right: np.ndarray) -> Iterator[list]:
    """For both sides the sums over their pairs of gradient, curvature and count, and the loss."""
    out = [np.zeros_like(x) for x in (left, right)] + [np.zeros(len(x)) for x in (left, right) * 2]
    loss = 0.0
    for _, context, node, ones, n, by_node, *first in sorted(blocks, key=lambda b: b[0]):
        x, y = left[context], right[node]
        f = np.einsum("ij,ij->i", x, y)
        loss += float((ones * np.logaddexp(0, -f) + (n - ones) * np.logaddexp(0, f)).sum())
        surely = np.clip(f, -MAX_EXP, MAX_EXP)
        pull = np.where(surely == f, ones - n / (1 + np.exp(-surely)), 0.0)[:, None]
        for k, (key, other, order) in enumerate(((context, y, slice(None)), (node, x, by_node))):
            ids = key[order][first[k]]
            out[k][ids] += np.add.reduceat((pull * other)[order], first[k])
            out[2 + k][ids] += np.add.reduceat((n * np.einsum("ij,ij->i", other, other))[order], first[k])
            out[4 + k][ids] += np.add.reduceat(n[order], first[k])
    yield [*out, loss]


def _moved(state: tuple, sums: Sequence, step: int, steps: int) -> tuple:
    """Both sides after a step; where the loss has risen, steps are halved from then on."""
    left, right, reach, before = state
    *sums, loss = sums
    reach = reach / 2 if loss > before else reach
    rate = 1 - step / steps
    sides = []
    for vectors, slope, curve, n in zip((left, right), sums[:2], sums[2:4], sums[4:6]):
        with np.errstate(divide="ignore"):
            most = reach * np.minimum(_MEAN_STEP * rate / n, _CURVATURE_STEP / curve)
        sides.append(vectors + np.minimum(LEARNING_RATE * rate / STEPS_A_PASS, most)[:, None] * slope)
    return *sides, reach, loss


def _passed(blocks: Iterator[tuple], state: tuple, first: int, last: int, steps: int) -> Iterator[tuple]:
    """Steps ``first`` to ``last`` over blocks that are all in this task."""
    blocks = list(blocks)
    for step in range(first, last):
        state = _moved(state, next(_slopes(iter(blocks), *state[:2])), step, steps)
    yield state


def train(
    docs: DataFrame, text_col: str, words: Sequence[str], counts: Sequence[int], vector_size: int,
    window: int, epochs: int, partitions: int, seed: int,
) -> np.ndarray:
    """One vector a word.

    The step falls in a line to zero over the passes, as in the training text by text. The
    sums of a step are a job over the blocks; the driver holds the vectors only. An alphabet
    whose table is a single block is trained in a job a pass instead.
    """
    random = np.random.default_rng(seed)
    left = (random.random((len(words), vector_size)) - 0.5) / vector_size
    right = np.zeros((len(words) - 1, vector_size))
    if not len(right):
        return left
    sc = docs.sparkSession.sparkContext
    pairs = pair_counts(docs, text_col, [code_of(w) for w in words], window)
    blocks = _blocks(pairs, huffman_paths(counts), len(words), window, partitions)
    state, steps, single = (left, right, 1.0, np.inf), epochs * STEPS_A_PASS, blocks.getNumPartitions() == 1
    try:
        for step in range(0, steps, STEPS_A_PASS if single else 1):
            now = sc.broadcast(state)
            if single:
                ends = step + STEPS_A_PASS
                state, = blocks.mapPartitions(
                    lambda part, now=now, step=step, ends=ends: _passed(part, now.value, step, ends, steps)
                ).collect()
            else:
                tasks = blocks.mapPartitions(lambda part, now=now: _slopes(part, *now.value[:2])).collect()
                state = _moved(state, [sum(values) for values in zip(*tasks)], step, steps)
            now.destroy()
    finally:
        blocks.unpersist()
    return state[0]
