"""Source divergence audit: exact divergences of sources, ranked by cells of equal counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import array, bound_batches
from .ordering import join_small

GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what separates terms
LEAST_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
SLICE_BYTES = 4_000_000  # of text that a task splits at a time
HELD = 1_000_000         # counts a task holds


def _slices(texts: pa.Array, keys: list[pa.Array]):
    """Parts of a batch of about SLICE_BYTES, a longer text by itself."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield texts.slice(start, i - start), [k.slice(start, i - start) for k in keys]
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield texts.slice(start), [k.slice(start) for k in keys]


KEYS = ["lang", "source", "term"]
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _terms(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Occurrences and documents of each term by language and source, a row a term and slice."""
    for texts, (lang, source) in _slices(array(batch, "text"), [array(batch, "lang"), array(batch, "source")]):
        words = pc.split_pattern_regex(pc.ascii_lower(texts), GAP)
        at = pa.table({"doc": pc.list_parent_indices(words), "term": pc.list_flatten(words)})
        at = at.filter(pc.not_equal(at["term"], ""))
        if at.num_rows:
            each = at.group_by(["doc", "term"]).aggregate([([], "count_all")])
            each = pa.table({"lang": pc.take(lang, each["doc"]), "source": pc.take(source, each["doc"]),
                             "term": each["term"], "n": each["count_all"]})
            found = each.group_by(KEYS).aggregate([("n", "sum"), ([], "count_all")])
            yield found.select([*KEYS, "n_sum", "count_all"]).rename_columns([*KEYS, "n", "docs"])


def _added(parts: list[pa.Table]) -> pa.Table:
    if len(parts) == 1:
        return parts[0]
    whole = pa.concat_tables(parts).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.select([*KEYS, "n_sum", "docs_sum"]).rename_columns([*KEYS, "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents.

    A task adds up its own counts and hands them on when they are HELD rows, so a word of
    every text is a row or a few a task. They are dealt out by language and term, and so
    are the results: what follows by that key needs no further exchange.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for found in _terms(batch):
                held.append(found)
                if sum(t.num_rows for t in held) >= HELD:
                    held = [_added(held)]
                    if held[0].num_rows >= HELD // 2:
                        yield from held.pop().combine_chunks().to_batches()
        if held:
            yield from _added(held).combine_chunks().to_batches()

    rows = docs.mapInArrow(run, COUNTS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "lang", "term").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)); exact, beyond 64 bits by decimals."""
    small = F.call_function("div", F.lit(SCALE) * (count + 1), F.nullif(n + v, F.lit(0)))
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    large = F.call_function("div", top, F.nullif((n + v).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)")))
    return 1 + F.when(count < 2 ** 63 // SCALE - 1, small).otherwise(large)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang",
                     source_col: str = "source", text_col: str = "text", few: int = 100_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Terms are runs of letters (every character beyond ASCII counts as one), A-Z in lower
    case; a language keeps those of ``least_docs`` documents or more. With ``p`` and ``q``
    the smoothed frequencies, in billionths, of a group and of what it is held against, a
    term weighs ``f = floor((p - q)^2 / q)``.

    - part ``pair``: every other source of the language, by the sum of f over all kept terms;
    - part ``term``: the ``top`` kept terms of the group that it uses more than the language.

    Both work on cells of equal counts, not on terms. For pairs, terms with the same
    counts in the same sources are one row with a multiplicity; what a pair does not share
    follows from the counts of each source alone. For terms, f is evaluated once a cell
    (group count, language count); cells of equal value merge into levels, the levels are
    ranked by cumulative multiplicity, and only those that begin within ``top`` are
    expanded, in UTF-8 order.

    Null text, lang and source are read as ''; groups without terms take part; rows count
    one by one, repeated or not. An empty table gives an empty one; other columns are not
    read. Tables of sources are broadcast up to ``few`` rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in
                         ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    by_term = term_counts(rows).groupBy("lang", "term").agg(
        F.sum("n").alias("whole"), F.sum("docs").alias("docs"),
        # at most one entry a source, of which the language's pairs have the square
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("uses"))
    kept = materialize(by_term.filter(F.col("docs") >= least_docs).drop("docs"))
    uses = kept.select("lang", "term", "whole", F.inline("uses"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n"))
    sums = uses.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("distinct"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                                           for c in ("group_n", "distinct", "v", "lang_n")]))
    n_groups = groups.count()
    return _pairs(kept, uses, groups, n_groups, few).unionByName(_top_terms(uses, groups, n_groups, top, few))


def _pairs(kept: DataFrame, uses: DataFrame, groups: DataFrame, n_groups: int, few: int) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    about = groups.select("lang", "source", "group_n", "distinct", "v",
                          _p(zero, F.col("group_n"), F.col("v")).alias("p0"))
    other = about.select("lang", F.col("source").alias("other_source"), F.col("group_n").alias("other_n"),
                         F.col("distinct").alias("other_distinct"), F.col("p0").alias("q0"))
    # every pair is a row of the result; large lists of sources are dealt out over salts
    salts = 1 + n_groups // 1000
    pairs = about.withColumn("_salt", F.pmod(F.xxhash64("source"), F.lit(salts))).join(
        other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "_salt"]
    ).filter("source <> other_source").drop("_salt")
    pairs = materialize(pairs)
    n_pairs = pairs.count()
    keys = ["lang", "source", "other_source"]
    # cells of two counts above 0, from patterns of equal counts
    patterns = kept.groupBy("lang", "uses").agg(F.count("*").alias("m"))
    one = patterns.select("lang", "uses", "m", F.posexplode("uses").alias("i", "a"))
    both = one.filter(F.size("uses") > F.col("i") + 1).select(
        "lang", "m", "a", F.explode(F.slice("uses", F.col("i") + 2, F.size("uses"))).alias("b"))
    cells = materialize(both.groupBy(
        "lang", F.col("a.source").alias("x"), F.col("b.source").alias("y"), F.col("a.n").alias("nx"),
        F.col("b.n").alias("ny")).agg(F.sum("m").alias("m")))
    ordered = cells.select("lang", F.col("x").alias("source"), F.col("y").alias("other_source"), F.col("nx").alias("mine"),
                           F.col("ny").alias("others"), "m").unionByName(
        cells.select("lang", F.col("y").alias("source"), F.col("x").alias("other_source"), F.col("ny").alias("mine"),
                     F.col("nx").alias("others"), "m"))
    # a shared term counts with f(p, q); the sums over single sources have taken it for
    # f(p, q0) and f(p0, q), and the number of unused terms for -1 x f(p0, q0)
    p, q, p0, q0 = F.col("p"), F.col("q"), F.col("p0"), F.col("q0")
    shared = join_small(ordered, pairs, keys, n_pairs, few).withColumns({
        "p": _p(F.col("mine"), F.col("group_n"), F.col("v")), "q": _p(F.col("others"), F.col("other_n"), F.col("v"))})
    shared = shared.select(*keys, (F.col("m") * (_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0))).alias("value"))
    singles = uses.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    singles = join_small(singles, about.select("lang", "source", "group_n", "v"), ["lang", "source"], n_groups, few)
    singles = materialize(singles.select("lang", "source", "m", _p(F.col("n"), F.col("group_n"), F.col("v")).alias("p")))
    alone = _matched(pairs, singles, ["lang", "source"], n_pairs, few).select(
        *keys, (F.col("m") * _f(p, q0)).alias("value"))
    turned = singles.select("lang", F.col("source").alias("other_source"), "m", F.col("p").alias("q"))
    absent = _matched(pairs, turned, ["lang", "other_source"], n_pairs, few).select(
        *keys, (F.col("m") * _f(p0, q)).alias("value"))
    unused = F.col("v") - F.col("distinct") - F.col("other_distinct")
    rest = pairs.select(*keys, F.when(F.col("v") > 0, unused * _f(p0, q0)).otherwise(zero).alias("value"))
    summed = shared.unionByName(alone).unionByName(absent).unionByName(rest).groupBy(*keys).agg(
        F.sum("value").cast("bigint").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other_source")
    return summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other_source").alias("item"), "value",
                         F.row_number().over(by_value).alias("rank"))


def _matched(pairs: DataFrame, singles: DataFrame, on: list[str], n_pairs: int, few: int) -> DataFrame:
    """Every count of a source with every pair the source is in."""
    if n_pairs <= few:
        return singles.join(F.broadcast(pairs), on)
    return singles.join(pairs, on)  # shuffled; skewed keys are split by adaptive execution


def _top_terms(uses: DataFrame, groups: DataFrame, n_groups: int, top: int, few: int) -> DataFrame:
    key = ["lang", "source"]
    about = groups.select(*key, "group_n", "v", "lang_n")
    cells = uses.groupBy(*key, "n", "whole").agg(F.count("*").alias("m"))

    def valued(rows: DataFrame) -> DataFrame:
        known = join_small(rows, about, key, n_groups, few)
        known = known.withColumn("p", _p(F.col("n"), F.col("group_n"), F.col("v"))).withColumn(
            "q", _p(F.col("whole"), F.col("lang_n"), F.col("v")))
        return known.filter("p > q").withColumn("f", _f(F.col("p"), F.col("q")))

    levels = valued(cells).groupBy(*key, "f").agg(F.sum("m").alias("m"))
    # a level holds a term at least, so the first `top` levels hold all ranks to `top`
    down = Window.partitionBy(*key).orderBy(F.desc("f"))
    levels = levels.withColumn("place", F.row_number().over(down)).filter(F.col("place") <= top)
    earlier = down.rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    levels = materialize(levels.filter(F.col("before") < top).select(*key, "f", "before"))
    members = join_small(valued(uses), levels, [*key, "f"], levels.count(), few)
    within = Window.partitionBy(*key, "f").orderBy("term")
    members = members.withColumn("nth", F.row_number().over(within)).filter(F.col("nth") <= top)
    rank = (F.col("before") + F.col("nth")).cast("int")
    return members.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"),
                          rank.alias("rank")).filter(F.col("rank") <= top)
