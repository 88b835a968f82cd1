"""SimHash near-duplicates: popcount embedding, grid range-join, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import array, column, map_rows
from .graph import components, spread_labels

SHINGLE, MAX_BITS, SEED = 3, 2, 42
SEGMENTS, SEGMENT_BITS = 16, 4
CELL_LIMIT = 512  # fingerprints of a cell that are compared with one another directly
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_NIBBLE = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)
_SHIFT = (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SEGMENT_BITS))
# one count of a segment takes three bits of a cell's code
_STEP = np.int64(1) << (np.arange(SEGMENTS, dtype=np.int64) * 3)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; zero for a text without words.

    A-Z is lower-cased, words end at ASCII white space, shingles are ``shingle`` words
    joined by blanks with repeats counted; fewer words make one shingle. A bit is set
    if it is in over half of the shingles' XXH64.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())],
                          dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):  # a long text needs no more memory than this
        bits = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(_BIT[counts * 2 > n].sum(dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, fp)`` of every row; ``bytes.lower`` changes A-Z only."""

    def run(batch: pa.RecordBatch):
        yield {"id": array(batch, "id"), "fp": [fingerprint(t, shingle) for t in column(batch, "text")]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_rows(rows, run, "id bigint, fp bigint").withColumnRenamed("id", id_col)


def _counts(fp: np.ndarray) -> np.ndarray:
    """Set bits of each segment: the embedding, of which the Manhattan distance is a
    lower bound of the Hamming distance."""
    return _NIBBLE[((fp.view(np.uint64)[:, None] >> _SHIFT) & np.uint64(15)).astype(np.int64)]


def _ball(counts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell code) of all grid points within ``steps`` of each row."""
    rows = np.arange(len(counts))
    found = [(rows, counts @ _STEP)]
    front = [(rows, counts, found[0][1])]
    for _ in range(steps):
        grown = []
        for who, at, code in front:
            for k in range(SEGMENTS):
                for move in (-1, 1):
                    ok = (at[:, k] + move >= 0) & (at[:, k] + move <= SEGMENT_BITS)
                    there = at[ok].copy()
                    there[:, k] += move
                    grown.append((who[ok], there, code[ok] + move * _STEP[k]))
        front = grown
        found += [(who, code) for who, _, code in grown]
    both = np.stack([np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])])
    return tuple(np.unique(both, axis=1)) if steps > 1 else tuple(both)


def _cells(prints: DataFrame, steps: int) -> DataFrame:
    """``(cell, fp)``: two fingerprints within 2 x steps in the grid share a cell."""

    def run(batch: pa.RecordBatch):
        fp = array(batch, "fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fp), 4096):
            part = fp[at:at + 4096]
            rows, code = _ball(_counts(part), steps)
            yield {"cell": pa.array(code), "fp": pa.array(part[rows])}

    return map_rows(prints, run, "cell bigint, fp bigint")


def _near(max_bits: int):
    """Spanning edges of the fingerprints of a cell that differ in few enough bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column(0).to_pylist():
                fp = np.array(members, dtype=np.int64)
                unsigned = fp.view(np.uint64)
                if len(fp) == 2:
                    if int(unsigned[0] ^ unsigned[1]).bit_count() <= max_bits:
                        us.append(members[0])
                        vs.append(members[1])
                    continue
                near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= max_bits
                root = spread_labels(near)
                moved = np.flatnonzero(root != np.arange(len(fp)))
                us += fp[moved].tolist()
                vs += fp[root[moved]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _shared_neighbours(fp: Column, flips: int) -> Column:
    """All values within ``flips`` flipped bits."""
    values = F.array(fp)
    one = F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))")
    for _ in range(flips):
        values = F.array_distinct(F.concat(values, F.flatten(F.transform(
            values, lambda x: F.transform(one, lambda b: x.bitwiseXOR(b))))))
    return values


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct fingerprints ``prints (fp)`` exactly as
    all pairs within ``max_bits`` would; not every pair is written.

    Both ends of such a pair are within ceil(max_bits / 2) grid steps of a common cell,
    so an equi-join on cells finds them. Cells of up to CELL_LIMIT fingerprints are
    compared in full. The fingerprints of larger cells go by shared neighbours: within
    2k flipped bits of each other means a common value within k flips of both, so
    equal values prove a link and each member needs one edge only, whatever the cell's
    size. For an odd ``max_bits`` one side is flipped once more.
    """
    steps = (max_bits + 1) // 2
    cells = _cells(prints.select("fp"), steps)
    counted = materialize(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("lo"),
                                                    F.max("fp").alias("hi")).filter("n > 1"))
    two = counted.filter("n = 2").select(F.array("lo", "hi").alias("members"))
    more = counted.filter(F.col("n").between(3, CELL_LIMIT)).select("cell")
    listed = cells.join(more, "cell").groupBy("cell").agg(F.collect_list("fp").alias("members")).select("members")
    edges = two.unionByName(listed).mapInArrow(_near(max_bits), "u bigint, v bigint")
    crowded = counted.filter(F.col("n") > CELL_LIMIT).select("cell")
    if crowded.isEmpty():
        return edges
    many = materialize(cells.join(crowded, "cell").select("fp").distinct())
    near = many.select("fp", F.explode(_shared_neighbours(F.col("fp"), max_bits // 2)).alias("z"))
    lowest = near.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = edges.unionByName(near.join(lowest, "z").select(F.col("fp").alias("u"), "v").filter("u <> v"))
    if max_bits % 2:
        wide = many.select("fp", F.explode(_shared_neighbours(F.col("fp"), steps)).alias("z"))
        edges = edges.unionByName(
            wide.join(near.withColumnRenamed("fp", "v"), "z").select(F.col("fp").alias("u"), "v").filter("u <> v"))
    return edges


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                          max_bits: int = MAX_BITS) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row.

    Documents are linked if their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable. Null, empty and blank texts have
    fingerprint zero and link like others; repeated rows stay repeated; null ids are
    ignored for the smallest (null if a component has no other); an empty table gives
    an empty one; other columns are not read. Equal fingerprints meet in a partial
    aggregate first, so copies cost no more than one row.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle).select(F.col(id_col).alias("id"), "fp"))
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    parts = components(links(prints, max_bits))
    named = prints.join(parts, prints.fp == parts.node, "left").select(
        "fp", "first", "n", F.coalesce("rep", "fp").alias("rep"), F.col("rep").isNotNull().alias("linked"))
    named = named.filter("linked or n > 1")
    lowest = named.groupBy("rep").agg(F.min("first").alias("component_id"))
    # only fingerprints that share a component are looked up; others are their own
    shared = materialize(named.join(lowest, "rep").select(F.col("fp").alias("key"), F.lit(True).alias("found"),
                                                          "component_id"))
    return rows.join(shared, rows.fp == shared.key, "left").select(
        F.col("id").alias(id_col), "fp",
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def hex16(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, all columns kept, one of each near-duplicate group: that of the
    smallest id. Of rows with equal id and text one stays; an id that stands for several
    texts stays if one of them is the first of its group. Rows with a null id are kept."""
    found = group_near_duplicates(docs, id_col, text_col, shingle, max_bits).filter(F.col(id_col).isNotNull())
    by_id = materialize(found.groupBy(id_col).agg(
        F.max(F.col(id_col) == F.col("component_id")).alias("first"), F.count("*").alias("rows")
    ).filter("not first or rows > 1"))
    kept = docs.join(by_id.filter("not first").select(id_col), id_col, "left_anti")
    again = by_id.filter("first and rows > 1").select(id_col)
    if not again.isEmpty():
        once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(again, id_col, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
