"""The registered queries of this package, with production parameters, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .common import LOWER, UPPER, fold_of, table
from .decontaminate import find_contamination
from .divergence import divergence_audit
from .embeddings import link_embeddings
from .langid import fit_language, predict_language
from .manifest import fold, manifest, proof
from .mixing import mix_sources
from .oracles import DIVERGENCE, MANIFEST
from .pii import find_personal_data
from .secrets import find_secrets
from .sentencepiece_scan import encode, load_pieces
from .simhash import group_near_duplicates, hex16
from .token_counts import TokenRollup, copies, count_tokens
from .toxicity import THRESHOLD, fit_toxicity, score_toxicity, training_labels
from .url_filter import Rule, filter_urls

TOKENIZERS = "/opt/tokenizers"
URL_RULES: list[Rule] = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def register(query: Query) -> Query:
    LLM_QUERIES[query.__name__] = query
    return query


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def _spans(keep: Callable[[Column], Column] | None = None) -> Column:
    spans = F.col("spans") if keep is None else F.filter("spans", keep)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in kinds), F.sha2(_spans(lambda s: s.base), 256).alias("base_sha256"),
                        _spans().alias("spans"))


@register
def op1_token_counts(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """All documents are inserted, later copies deleted, and texts with runs of white
    space counted again after tidying; the deletes then arrive a second time."""
    docs = table(spark, sf_dir, "documents")
    tokenizer = {name: f"{folder}/{name}.tiktoken" for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    rollup = TokenRollup(spark, scratch(spark, "token-rollup"))
    counts = materialize(count_tokens(docs, tokenizer))
    rollup.apply(1, counts)
    gone = materialize(copies(docs))
    deletes = counts.join(gone, "doc_id", "left_semi")
    rollup.apply(2, deletes, live=False)
    untidy = docs.filter(F.col("text").rlike(r"\s\s")).join(gone, "doc_id", "left_anti")
    tidy = untidy.withColumn("text", F.regexp_replace("text", r"(\s)\s+", "$1"))
    rollup.apply(3, count_tokens(tidy, tokenizer))
    rollup.apply(2, deletes, live=False)
    return rollup.totals()


@register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


@register
def op3_sentencepiece(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), load_pieces(f"{folder}/piece_bpe_32k.model"))
    return found.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "round_trip")


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    found = score_toxicity(docs, model, keep=("doc_id",))
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.filter(fold_of("doc_id", 4) != 2))
    found = predict_language(docs, model)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@register
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(find_personal_data(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))


@register
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


@register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(hits, 0L, (n, h) -> n + h.to - h.from)")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@register
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


@register
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


@register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        fold(F.col("path"), F.col("altered")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@register
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


LLM_ORACLES["op11_source_divergence"] = DIVERGENCE
LLM_ORACLES["op12_merkle_manifest"] = MANIFEST

LLM_ORACLES["op7_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), " \
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LLM_ORACLES["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM win), unnest(range(1, len(w) - k + 2)) AS t(i)
), occ AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM occ GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

LLM_ORACLES["op10_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN parts ON parts.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""
