"""Merkle manifest of a dataset: nodes as nested intervals of leaf ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower
from .ordering import rank_within

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(col: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a document row, with its own text or another."""
    values = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return sha(*map(field, values))


def _digests(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda k: k.digest), "")


def _step(kids: str, lo: Column, hi: Column) -> Column:
    """The siblings of the interval [lo, hi): what its parent covers less the interval."""
    left = F.filter(F.col(kids), lambda k: k.hi <= lo)
    right = F.filter(F.col(kids), lambda k: k.lo >= hi)
    return F.struct(_digests(left).alias("left"), _digests(right).alias("right"))


def build_levels(leaves: DataFrame, payload: tuple[str, ...] = ()) -> list[DataFrame]:
    """The nodes of all trees by level, ``(tree, size, lo, hi, digest, kids)`` each.

    ``leaves`` has ``tree, size`` (leaves of the tree), ``lo, hi, digest`` and the
    ``payload`` columns, which the children of the first level keep. A node of level L
    covers the leaf ranks [lo, hi) of a run of ARITY ** L; at most ARITY nodes meet in a
    group, so no tree is too large for a task. Every level is written: it is read on the
    way up and again on the way down.
    """
    levels, width = [], 1
    top = leaves.agg(F.max("size")).first()[0] or 0
    below = leaves
    while width < top:
        kept = payload if width == 1 else ()
        rest = below.filter(F.col("size") > width)  # trees with more than one node here
        width *= ARITY
        nodes = rest.groupBy("tree", "size", F.floor(F.col("lo") / width).alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *kept))).alias("kids"))
        below = materialize(nodes.withColumn("digest", F.sha2(_digests(F.col("kids")).cast("binary"), 256))
                            .drop("bucket"))
        levels.append(below)
    return levels


def attach_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first level with ``path``, the siblings from their own level to
    the root, and the columns of ``above`` (one row a tree, with the path beyond it).

    From the roots downwards, the nodes of a level meet their parents by a containment
    join: the level's bucket is the key, the intervals must nest, and the interval
    difference within the parent gives the siblings. A parent has ARITY children at most,
    so no key is hot, and what is joined shrinks by ARITY a level.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    known: DataFrame | None = None
    for at in range(len(levels) - 1, -1, -1):
        width = ARITY ** (at + 1)
        nodes = levels[at]
        roots = nodes.filter(F.col("size") <= width).join(above, "tree")
        found = roots.select(*nodes.columns, "path", *extra)
        if known is not None:
            wider = width * ARITY
            child = nodes.withColumn("bucket", F.floor(F.col("lo") / wider)).alias("c")
            parent = known.withColumn("bucket", F.floor(F.col("lo") / wider)).alias("p")
            nested = ((F.col("c.tree") == F.col("p.tree")) & (F.col("c.bucket") == F.col("p.bucket"))
                      & (F.col("p.lo") <= F.col("c.lo")) & (F.col("c.hi") <= F.col("p.hi")))
            step = _step("p.kids", F.col("c.lo"), F.col("c.hi"))
            inner = child.join(parent, nested).select(
                *[F.col(f"c.{c}") for c in nodes.columns],
                F.concat(F.array(step), F.col("p.path")).alias("path"), *[F.col(f"p.{c}") for c in extra])
            found = found.unionByName(inner)
        known = found
    return known


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, path, altered, tampered``.

    Documents are leaves of their source's tree by ascending doc_id (null first, equal ids
    by digest); the subroots of the sources, null first and then bytewise, are the leaves
    of the tree above. ``path`` lists the siblings level by level up to the root, those to
    the left and those to the right of the way. ``altered`` is the digest of the row as it
    would arrive where 5 divides crc32 of the decimal doc_id: with the A-Z of its text in
    lower case; elsewhere, also for a null id or text, it is ``leaf``.

    Repeated rows are leaves of their own. An empty table gives an empty result; a lone
    document's leaf is subroot and root. Columns beyond FIELDS are not read.
    """
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.when(hit, leaf_digest(ascii_lower("text")))
    # the last column spreads equal rows over the ranges of the sort
    leaves = materialize(rows.select("doc_id", "source", leaf_digest().alias("leaf"), lower.alias("altered"),
                                     F.monotonically_increasing_id().alias("spread")))
    ranked = rank_within(leaves, ["source"], ["doc_id", "leaf", "spread"])
    trees = rank_within(ranked.filter("rank = 0").select("source", F.col("size").alias("n")), [], ["source"])
    trees = materialize(trees.select("source", F.col("rank").alias("tree"), F.col("n").alias("leaves"), "size"))
    # a source's first rank and the tree's number; source sizes are broadcast only where few
    count = trees.count()
    names = trees.select("source", "tree")
    nodes = _numbered(ranked, names, count)
    levels = build_levels(nodes, ("doc_id", "altered"))
    subroots = nodes.filter("size = 1").select("tree", "digest")
    for i, level in enumerate(levels):
        subroots = subroots.unionByName(level.filter(F.col("size") <= ARITY ** (i + 1)).select("tree", "digest"))
    # the tree over the sources
    tops = materialize(subroots.join(trees.select("tree", "size"), "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("size"), F.col("tree").alias("lo"),
        (F.col("tree") + 1).alias("hi"), "digest"))
    upper = build_levels(tops)
    empty = F.array().cast(f"array<{STEP}>")
    if upper:
        root = upper[-1].select(F.col("tree"), F.col("digest").alias("root"), empty.alias("path"))
        above = _open(attach_paths(upper, root), ("root",)).select(
            F.col("lo").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    else:
        above = tops.select(F.col("lo").alias("tree"), F.col("digest").alias("subroot"),
                            F.col("digest").alias("root"), empty.alias("path"))
    above = materialize(above)
    lone = nodes.filter("size = 1").join(above, "tree").select(
        "doc_id", F.col("digest").alias("leaf"), "altered", "subroot", "root", "path")
    if levels:
        below = _open(attach_paths(levels, above), ("subroot", "root")).select(
            "doc_id", F.col("digest").alias("leaf"), "altered", "subroot", "root", "path")
        lone = below.unionByName(lone)
    return lone.select("doc_id", "leaf", "subroot", "root", "path", F.coalesce("altered", "leaf").alias("altered"),
                       F.col("altered").isNotNull().alias("tampered"))


def _numbered(ranked: DataFrame, names: DataFrame, count: int) -> DataFrame:
    """Leaves with the number of their tree. Few sources are broadcast; many are joined
    on (source, block of ranks), so that a large source is many keys."""
    leaf = ranked.withColumn("block", F.floor(F.col("rank") / 1_000_000)).alias("l")
    if count <= 100_000:
        joined = leaf.join(F.broadcast(names.alias("t")), F.col("l.source").eqNullSafe(F.col("t.source")))
    else:
        blocks = ranked.groupBy("source").agg(F.max("size").alias("n")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1_000_000))))
        split = blocks.alias("b").join(names.alias("n"), F.col("b.source").eqNullSafe(F.col("n.source"))).select(
            "b.source", "b.block", "n.tree").alias("t")
        joined = leaf.join(split, F.col("l.source").eqNullSafe(F.col("t.source")) & (F.col("l.block") == F.col("t.block")))
    return materialize(joined.select("t.tree", "l.size", F.col("l.rank").alias("lo"), (F.col("l.rank") + 1).alias("hi"),
                                     F.col("l.leaf").alias("digest"), "l.doc_id", "l.altered"))


def _open(runs: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """The leaves of first-level nodes, each with its whole path."""
    leaf = runs.select("kids", "path", *extra, F.explode("kids").alias("me"))
    step = _step("kids", F.col("me.lo"), F.col("me.hi"))
    return leaf.select("me.*", *extra, F.concat(F.array(step), F.col("path")).alias("path"))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda d, s: sha(s.left, d, s.right))
