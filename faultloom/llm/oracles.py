"""SQL twins, for DuckDB, of the audit queries."""

from __future__ import annotations

from .common import LOWER, UPPER

DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
uses AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
whole AS (
  SELECT lang, g.source, term, coalesce(n, 0) AS n
  FROM groups g JOIN kept USING (lang) LEFT JOIN uses USING (lang, source, term)
), gp AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p
  FROM whole JOIN size USING (lang)
), lp AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM uses GROUP BY ALL) JOIN size USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value
  FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT
  FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, height: int) -> str:
    """Levels 1 to ``height`` above ``name``0 (tree, i, d, n: nodes left), then for every
    level below the top the text to the left and to the right of a node in its run."""
    parts = [f"""{name}{k + 1} AS (
  SELECT tree, i // 16 AS i, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d,
         (n + 15) // 16 AS n
  FROM {name}{k} GROUP BY tree, i // 16, n)""" for k in range(height)]
    parts += [f"""{name}_side{k} AS (
  SELECT a.tree, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 16 = b.i // 16
  WHERE a.n > 1 GROUP BY a.tree, a.i)""" for k in range(height)]
    return ",\n".join(parts)


def _climb(name: str, source: str, tree: str, at: str, height: int, out: str) -> str:
    """``source`` with its ``proof`` text and ``folded`` digest carried up one tree."""
    parts = []
    for k in range(height):
        parts.append(f"""{out}{k} AS (
  SELECT b.* EXCLUDE (proof, folded), proof || coalesce(l || r, '') AS proof,
         CASE WHEN l IS NULL THEN folded ELSE sha256(l || folded || r) END AS folded
  FROM {source} b LEFT JOIN {name}_side{k} s ON s.tree = b.{tree} AND s.i = b.{at} // {16 ** k})""")
        source = f"{out}{k}"
    return ",\n".join(parts)


# the unrolled levels reach 16 ** 5 documents a source and 16 ** 3 sources
MANIFEST = rf"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc(id, pos, c) AS (
  SELECT DISTINCT doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT id, pos + 1, xor(c >> 8, v) FROM crc JOIN bits ON k = 8 AND b = xor(c & 255, ascii(substr(id, pos + 1, 1)))
  WHERE pos < length(id)
), altered AS (SELECT id FROM crc WHERE pos = length(id) AND xor(c, 4294967295) % 5 = 0),
docs AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN altered.id IS NOT NULL THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")}
              ELSE {_leaf('text')} END AS sent
  FROM documents LEFT JOIN altered ON altered.id = doc_id::VARCHAR
), named AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM docs)),
base AS (
  SELECT doc_id, leaf, sent AS folded, '' AS proof, tree,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n
  FROM docs JOIN named ON named.source IS NOT DISTINCT FROM docs.source
), low0 AS (SELECT tree, i, leaf AS d, n FROM base),
{_tree('low', 5)},
high0 AS (SELECT 0 AS tree, tree AS i, d, count(*) OVER () AS n FROM low5),
{_tree('high', 3)},
{_climb('low', 'base', 'tree', 'i', 5, 'up')},
placed AS (SELECT *, 0 AS top FROM up4),
{_climb('high', 'placed', 'top', 'tree', 3, 'over')}
SELECT doc_id, leaf, low5.d AS subroot, high3.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = high3.d AS verified
FROM over2 JOIN low5 ON low5.tree = over2.tree, high3"""
