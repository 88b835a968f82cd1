"""URL filter: a broadcast trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, array, ascii_lower, map_rows

Rule = tuple[str, str, str]  # verdict, host, path
_LOWER = str.maketrans(UPPER, LOWER)
SCHEMA = "host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class HostTrie:
    """Rules by host labels from the right, then by the segments of their path.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    The longest wins: more host labels first, then the longer path; of equal rules
    that differ in verdict, block wins.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            *full, tail = path.split("/")
            node = node.setdefault("paths", {})
            for segment in full:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            tails = node.setdefault("tails", {})
            if tails.get(tail, ("", ""))[1] != "block":
                tails[tail] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning ``(rule, verdict)``."""
        best, node = None, self.root
        segments = path.split("/")
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            if "paths" in node:
                best = self._path(node["paths"], segments) or best
            node = node.get("labels", {}).get(next(labels, None))
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            tails = node.get("tails", {})
            fit = [t for t in tails if segment.startswith(t)]
            if fit:
                best = tails[max(fit, key=len)]
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """One row per page: id, host, path, winning rule (else null) and verdict
    (else ``default``).

    Null urls, urls without ``://`` and empty hosts fit only rules without a host and
    a path that is empty. Repeated pages are judged one by one; an empty table gives an
    empty result; other columns are not read. The trie is broadcast and holds at most
    ``max_rules`` rules; ``filter_urls_joined`` takes rule tables of any size.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules are more than {max_rules}: use filter_urls_joined")
    trie = pages.sparkSession.sparkContext.broadcast(HostTrie(rules))

    def judge(batch: pa.RecordBatch):
        seen = [split_url(u) for u in array(batch, "url").to_pylist()]
        found = [trie.value.match(*x) for x in seen]
        yield {
            "id": array(batch, "id"), "host": [x[0] for x in seen], "path": [x[1] for x in seen],
            "rule": [x and x[0] for x in found], "verdict": [x[1] if x else default for x in found],
        }

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    return map_rows(rows, judge, f"id bigint, {SCHEMA}").withColumnRenamed("id", id_col)


def filter_urls_joined(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                       default: str = "allow") -> DataFrame:
    """As ``filter_urls`` for a table ``rules (verdict, host, path)`` of any size.

    Each url is looked up under every suffix of its host and every prefix of its path
    whose length some rule's path has (those lengths are few and counted first), by an
    equi-join on distinct (host, path) pairs.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().limit(10_001).collect())
    if len(lengths) > 10_000:
        raise ValueError("rule paths have over 10,000 different lengths")
    after = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    rest = F.coalesce(F.regexp_extract(after, r"(?s)^([^?#]*)", 1), F.lit(""))
    cut = pages.select(F.col(id_col).alias("id"), rest.alias("rest")).select(
        "id", ascii_lower(F.substring_index("rest", "/", 1)).alias("host"),
        F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)").alias("path"),
    )
    labels = F.split("host", r"\.")
    keys = cut.select("host", "path").distinct().select(
        "host", "path",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(labels)), lambda i: F.when(
            i == F.size(labels), F.lit("")).otherwise(F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
        ).alias("suffix"),
    ).distinct().select("host", "path", "suffix", F.explode(
        F.filter(F.array([F.lit(n) for n in lengths] or [F.lit(0)]), lambda n: n <= F.length("path"))).alias("n"))
    keyed = keys.select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("prefix"))
    listed = rules.select(ascii_lower("host").alias("suffix"), F.col("path").alias("prefix"),
                          F.concat("host", "path").alias("rule"), "verdict")
    rank = F.struct(F.when(F.col("suffix") == "", 0).otherwise(F.size(F.split("suffix", r"\."))),
                    F.length("prefix"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    best = keyed.join(listed, ["suffix", "prefix"]).groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return cut.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
