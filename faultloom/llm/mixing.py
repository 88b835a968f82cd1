"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import join_small, rank_within

WEIGHTS = (5, 2, 1)
MOST = 3.0      # copies of a document, and words of a source as a multiple of its size
ARITY = 16      # residuals that meet in a fold of the reduction tree
RESERVE = 64    # residuals of a size class that wait for the last fold of their source
WORD = r"[^\x20\x09-\x0D]+"
SEED = 13
DONE = "array<struct<doc_id:bigint,size:bigint,extra:int>>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, tree, target)`` from ``(source, source_size)``, one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words;
    a target stops at ``most`` times its source's size and the excess is shared again by
    weight until none is above. The level (target per weight) only rises, so every round
    is one small aggregate over the sources, and two sums come to the driver. ``tree``
    numbers the sources. Sources without words have the target 0.
    """
    # the rank has nulls first; a flag before the name puts them last
    flagged = sizes.select("source", "source_size", F.col("source").isNull().alias("unnamed"))
    ranked = rank_within(flagged, [], ["unnamed", "source"])
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = materialize(ranked.select("source", "source_size", F.col("rank").alias("tree"), F.element_at(
        turn, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")))
    cap = F.col("source_size") * F.lit(float(most))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = (cap <= F.col("weight") * F.lit(level)) if capped >= 0 else F.lit(False)
        held, free, n = rows.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))),
                                 F.count(F.when(full, 1))).first()
        if n == capped or not free:
            break
        level, capped = (total - (held or 0.0)) / free, n
    return rows.select("source", "source_size", "tree", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(SEED)), 11) / F.lit(float(2 ** 53))


def _settle(state: Column, x: Column) -> Column:
    """Pair the carried document with the next one: words move from one probability to
    the other, at random and with both expectations kept, until one of them is 0 or 1."""
    a, b = state.carry, x
    a_room, b_room = a.size * (1 - a.p), b.size * (1 - b.p)
    a_mass, b_mass = a.size * a.p, b.size * b.p
    up, down = F.least(a_room, b_mass), F.least(a_mass, b_room)
    rise = b.u * (up + down) < down
    # the first to reach its border is settled, the other one goes on with the rest
    first = F.when(rise, a_room <= b_mass).otherwise(a_mass <= b_room)

    def done(d: Column, yes: Column) -> Column:
        return F.array(F.struct(d.doc_id.alias("doc_id"), d.size.alias("size"), yes.cast("int").alias("extra")))

    def carry(d: Column, moved: Column) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), d.p + moved / d.size))
        return F.struct(d.doc_id.alias("doc_id"), d.size.alias("size"), p.alias("p"), d.u.alias("u"))

    settled = F.when(first, done(a, rise)).otherwise(done(b, ~rise))
    going = F.when(first, carry(b, F.when(rise, -up).otherwise(down))).otherwise(
        carry(a, F.when(rise, up).otherwise(-down)))
    return F.struct(going.alias("carry"), F.concat(state.done, settled).alias("done"))


def _met(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    item = F.struct(order.alias("at"), "doc_id", "size", "p", "u")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("met"))


def _fold(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One residual (``carry``) and the settled documents (``done``) of each group."""
    met = _met(rows, keys, order)
    bare = F.transform("met", lambda m: F.struct(m.doc_id.alias("doc_id"), m["size"].alias("size"),
                                                 m.p.alias("p"), m.u.alias("u")))
    met = met.withColumn("met", bare)
    start = F.struct(F.col("met")[0].alias("carry"), F.array().cast(DONE).alias("done"))
    folded = met.withColumn("out", F.aggregate(F.slice("met", 2, F.greatest(F.size("met") - 1, F.lit(1))), start, _settle))
    return folded.select(*keys, "out.carry", "out.done")


def _settle_against_rest(state: Column, x: Column) -> Column:
    """Pair a document with all that come after it, taken as one: words move between it
    and them in proportion, at random and with both expectations kept, until it is 0 or 1.

    A document so large that the rest can offset only one of the two goes that way; if
    the rest can offset neither, all of it becomes 0 or 1 and the document is rounded. What earlier steps did to the probabilities of the rest is the map p -> scale * p +
    shift; ``mass`` and ``words`` are the rest's expected and whole words.
    """
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), state.scale * x.p + state.shift))
    words = state.words - x["size"]
    mass = F.greatest(F.lit(0.0), F.least(words, state.mass - x["size"] * own))
    room = words - mass
    to_one, to_zero = x["size"] * (1 - own), x["size"] * own
    up, down = F.least(to_one, mass), F.least(to_zero, room)
    rise = F.when((to_one <= mass) == (to_zero <= room), x.u * (up + down) < down).otherwise(to_one <= mass)
    # the share of the rest's words (or of its room) that is left after the step
    left = F.when(rise, 1 - up / F.greatest(mass, F.lit(1e-300))).otherwise(
        1 - down / F.greatest(room, F.lit(1e-300)))
    moved = own + F.when(rise, up).otherwise(-down) / x["size"]
    settled = F.struct(x.doc_id.alias("doc_id"), x["size"].alias("size"), (moved >= 0.5).cast("int").alias("extra"))
    return F.struct(
        (state.scale * left).alias("scale"),
        (state.shift * left + F.when(rise, F.lit(0.0)).otherwise(1 - left)).alias("shift"),
        F.when(rise, mass - up).otherwise(mass + down).alias("mass"), words.alias("words"),
        F.concat(state.done, F.array(settled)).alias("done"))


def _last_fold(rows: DataFrame) -> DataFrame:
    """``(tree, done)``: the documents from the largest to the smallest, each settled
    against the rest."""
    met = _met(rows, ["tree"], F.struct(-F.col("size"), F.col("class"), F.col("at")))
    words = F.aggregate("met", F.lit(0.0), lambda n, m: n + m["size"])
    mass = F.aggregate("met", F.lit(0.0), lambda n, m: n + m["size"] * m.p)
    start = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), mass.alias("mass"), words.alias("words"),
                     F.array().cast(DONE).alias("done"))
    return met.select("tree", F.aggregate("met", start, _settle_against_rest).done.alias("done"))


def _done(folded: DataFrame) -> DataFrame:
    return folded.select("tree", F.explode("done").alias("d")).select("tree", "d.*")


def round_copies(rows: DataFrame) -> DataFrame:
    """``(tree, doc_id, size, extra)`` from ``(tree, doc_id, size, p)``: ``extra`` is 1
    with probability ``p`` (but for documents that the smaller ones of their tree cannot
    offset), else 0, and the words of a tree that it picks equal the expected words but for
    part of one document, as a rule of the smallest size.

    Documents are classed by the binary length of their size. Within a class a reduction
    tree folds ARITY residuals at a time, in which all but one are settled, until RESERVE
    are left at most. A last fold a tree (RESERVE a class, 63 classes) pairs these, from
    the largest to the smallest, with all smaller ones, so the error is left with the
    smallest documents, unless one holds more words than the rest can offset. Folds go by
    rank, random numbers by the hash of their place, so reruns agree. Rows have sizes
    above 0; an empty table gives an empty one.
    """
    classed = materialize(rows.select("tree", "doc_id", "size", "p", F.length(F.bin("size")).alias("class"),
                                      F.xxhash64("doc_id", F.lit(SEED)).alias("mixed"),
                                      F.monotonically_increasing_id().alias("spread")))
    placed = rank_within(classed.withColumnRenamed("size", "words"), ["tree", "class"],
                         ["mixed", "doc_id", "words", "spread"])
    left = placed.select("tree", "class", "doc_id", F.col("words").alias("size"), "p", F.col("rank").alias("at"),
                         F.col("size").alias("n"), _uniform("tree", "class", F.lit(0), "rank").alias("u"))
    most = left.agg(F.max("n")).first()[0] or 0
    settled, waiting, level = [], [], 0
    while most > RESERVE:
        waiting.append(left.filter(F.col("n") <= RESERVE))
        groups = left.filter(F.col("n") > RESERVE).withColumn("block", F.floor(F.col("at") / ARITY))
        folded = materialize(_fold(groups, ["tree", "class", "n", "block"], F.col("at")))
        settled.append(_done(folded))
        level += 1
        left = folded.select("tree", "class", "carry.doc_id", "carry.size", "carry.p", F.col("block").alias("at"),
                             F.ceil(F.col("n") / ARITY).alias("n"),
                             _uniform("tree", "class", F.lit(level), "block").alias("u"))
        most = -(-most // ARITY)
    for part in waiting:
        left = left.unionByName(part)
    out = _done(materialize(_last_fold(left)))
    for part in settled:
        out = out.unionByName(part)
    return out


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` for every document.

    ``size`` is its number of words, ``target`` the words its source should give (see
    source_targets), ``taken`` the words that the mix takes, copies counted. Every document
    of a source is expected ``target / source_size`` times: the whole part for each, the
    rest by dependent rounding, so a document is taken at most ``most`` (a whole number)
    times and a source's taken words differ from its target by part of one small document.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source, the
    last one; null and repeated ids are documents like others. An empty table gives an
    empty one; other columns are not read.
    """
    rows = materialize(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, most).withColumn("named", F.coalesce("source", F.lit("")))
                          .withColumn("unnamed", F.col("source").isNull()).drop("source"))
    keyed = rows.withColumn("named", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull())
    known = join_small(keyed, targets, ["named", "unnamed"], targets.count()).select(
        "doc_id", "size", "source_size", "target", "tree",
        F.when(F.col("source_size") > 0, F.col("target") / F.nullif("source_size", F.lit(0)))
        .otherwise(F.lit(0.0)).alias("copies"))
    known = known.withColumn("whole", F.floor("copies"))
    empty = known.filter("size = 0").select("doc_id", "size", "tree", F.lit(0).alias("extra"))
    extra = round_copies(known.filter("size > 0").select("tree", "doc_id", "size", (F.col("copies") - F.col("whole")).alias("p")))
    out = join_small(extra.unionByName(empty), targets.select("tree", "source_size", "target"), ["tree"], targets.count())
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(0)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * (whole + F.col("extra"))).cast("bigint").alias("taken"))
