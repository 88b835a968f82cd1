"""The registered queries as SQL for the check, written the plain way: the full
fault x log join, window deduplication, all n-grams."""

from __future__ import annotations

from ..functions.categories import CATEGORY_IDS, UNKNOWN_CATEGORY
from ..functions.stop_words import ENGLISH_STOP_WORDS
from .fixtures import LOGIT_SCALE

ORACLES: dict[str, str] = {}

_EVENTS = """
ev AS (
  SELECT event_id, event_type, user_id,
         'SN' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS sn,
         date_trunc('second', ts) AS time,
         CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS time_ts,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events),
logs AS (
  SELECT sn, time, time_ts, event_id AS ord, 'SM' || (user_id % 12) AS server_model,
         CASE event_type WHEN 'view' THEN 'Memory' WHEN 'click' THEN 'System'
              WHEN 'signup' THEN 'Processor' WHEN 'purchase' THEN 'Drive' ELSE 'Gizmo' END
         || ' #0x' || (k % 10) || ' | ' || event_type || ' | Asserted' AS raw_msg
  FROM ev),
all_faults AS (
  SELECT sn, time AS fault_time, time_ts AS fault_time_ts,
         CASE WHEN k < 10 THEN 0 WHEN k < 30 THEN 1 WHEN k < 60 THEN 2 ELSE 3 END AS label
  FROM ev WHERE event_type = 'error'),
faults AS (SELECT DISTINCT * FROM all_faults)"""

_CASES = " ".join(f"WHEN '{t}' THEN {i}" for t, i in CATEGORY_IDS.items())
_CATEGORY_ID = f"CASE string_split(trim(msg), ' ')[1] {_CASES} ELSE {UNKNOWN_CATEGORY} END"


def _history(dedup_on: str = "msg") -> str:
    return f"""{_EVENTS},
pairs AS (
  SELECT f.*, l.time, l.time_ts, l.ord, l.server_model, l.raw_msg,
         replace(l.raw_msg, '|', '') AS msg
  FROM faults f JOIN logs l ON f.sn = l.sn AND l.time <= f.fault_time),
dedup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY sn, fault_time_ts, label, {dedup_on}
                                 ORDER BY time DESC, ord DESC) AS again FROM pairs)
  WHERE again = 1),
capped AS (
  SELECT *, {_CATEGORY_ID} AS category_id,
         len(string_split(msg, ' ')) AS word_cnt, length(msg) AS char_cnt
  FROM (
    SELECT *, row_number() OVER (PARTITION BY sn, fault_time_ts, label
                                 ORDER BY time, ord) AS position FROM dedup)
  WHERE position <= 40),
last_cat AS (
  SELECT sn, fault_time_ts, label, category_id AS last_category_id FROM (
    SELECT *, row_number() OVER (PARTITION BY sn, fault_time_ts, label
                                 ORDER BY time DESC, ord DESC) AS r FROM capped)
  WHERE r = 1),
mode_cat AS (
  SELECT sn, fault_time_ts, label, category_id AS mode_category_id FROM (
    SELECT sn, fault_time_ts, label, category_id,
           row_number() OVER (PARTITION BY sn, fault_time_ts, label
                              ORDER BY count(*) DESC, category_id) AS r
    FROM capped GROUP BY sn, fault_time_ts, label, category_id)
  WHERE r = 1),
spans AS (
  SELECT sn, fault_time, fault_time_ts, label, count(*) AS dup_log_cnt,
         min(time_ts) AS min_time_ts, max(time_ts) AS max_time_ts
  FROM capped GROUP BY ALL),
flagged AS (
  SELECT c.*, last_category_id, mode_category_id
  FROM capped c JOIN last_cat USING (sn, fault_time_ts, label)
                JOIN mode_cat USING (sn, fault_time_ts, label))"""


_V2 = _history() + """,
texts AS (
  SELECT sn, fault_time_ts, label, string_agg(msg, '。' ORDER BY time, ord) AS msg
  FROM dedup GROUP BY ALL),
per_model AS (
  SELECT sn, fault_time_ts, label, server_model, last_category_id, mode_category_id,
         count(DISTINCT category_id) AS category_nunique,
         avg(CASE WHEN category_id = last_category_id THEN 1.0 ELSE 0.0 END) AS last_category_occupy,
         avg(CASE WHEN category_id = mode_category_id THEN 1.0 ELSE 0.0 END) AS mode_category_occupy,
         avg(word_cnt) AS word_cnt_mean, CAST(sum(word_cnt) AS BIGINT) AS word_cnt_sum,
         avg(char_cnt) AS char_cnt_mean, CAST(sum(char_cnt) AS BIGINT) AS char_cnt_sum,
         count(*) AS tail_log_cnt, min(time_ts) AS min_time_ts
  FROM flagged WHERE server_model IS NOT NULL GROUP BY ALL),
v2 AS (
  SELECT p.sn, p.fault_time_ts, p.label, p.server_model, last_category_id, mode_category_id,
         category_nunique, round(last_category_occupy, 6) AS last_category_occupy,
         round(mode_category_occupy, 6) AS mode_category_occupy,
         round(word_cnt_mean, 6) AS word_cnt_mean, word_cnt_sum,
         round(char_cnt_mean, 6) AS char_cnt_mean, char_cnt_sum, tail_log_cnt, p.min_time_ts,
         p.sn || p.fault_time_ts || p.label AS id,
         p.fault_time_ts - p.min_time_ts AS tail_max_time_gap,
         round((p.fault_time_ts - p.min_time_ts) / tail_log_cnt, 6) AS tail_mean_time_gap,
         dup_log_cnt, p.fault_time_ts - s.min_time_ts AS dup_max_time_gap,
         round((p.fault_time_ts - s.min_time_ts) / dup_log_cnt, 6) AS dup_mean_time_gap,
         p.fault_time_ts - max_time_ts AS last_time_gap,
         CAST(hour(fault_time) AS INTEGER) AS fault_hour
  FROM per_model p JOIN spans s USING (sn, fault_time_ts, label))"""

ORACLES["faults_csv"] = f"""WITH {_EVENTS}
SELECT sn, fault_time_ts, label, CAST(hour(fault_time) AS INTEGER) AS fault_hour FROM faults
UNION ALL
SELECT DISTINCT sn, time_ts, -1, CAST(hour(time) AS INTEGER) FROM ev WHERE event_type = 'signup'"""

ORACLES["logs_csv"] = f"""WITH {_EVENTS}
SELECT sn, time_ts, raw_msg AS msg, server_model,
       row_number() OVER (PARTITION BY sn ORDER BY server_model >= 'SM5', ord)::INT AS place FROM logs"""

ORACLES["crashdump_csv"] = f"""WITH {_EVENTS}
SELECT sn, time_ts AS ts, raw_msg AS fault_code FROM logs"""

ORACLES["venus_csv"] = f"""WITH {_EVENTS}
SELECT sn, time_ts AS ts, raw_msg AS module_cause, CASE WHEN server_model < 'SM5' THEN server_model END AS module
FROM logs"""

ORACLES["sorted_tables"] = f"""WITH {_EVENTS}
SELECT 'faults' AS name, count(*) AS n_rows, TRUE AS in_order FROM faults
UNION ALL SELECT 'logs', count(*), TRUE FROM logs"""

ORACLES["fault_history_join"] = f"""WITH {_history()}
SELECT sn, fault_time_ts, label, sn || fault_time_ts || label AS id,
       count(*) AS history_cnt, CAST(sum(length(raw_msg)) AS BIGINT) AS history_chars,
       CAST(sum(time_ts) AS BIGINT) AS history_ts_sum
FROM pairs GROUP BY sn, fault_time_ts, label"""

for _name, _on in (("fault_history_dedup", "msg"), ("fault_history_dedup_v1", "raw_msg")):
    ORACLES[_name] = f"""WITH {_history(_on)}
SELECT sn, fault_time_ts, label, count(*) AS message_cnt,
       CAST(sum(length(msg)) AS BIGINT) AS char_sum,
       CAST(sum(len(string_split(msg, ' '))) AS BIGINT) AS word_sum,
       CAST(sum(time_ts) AS BIGINT) AS time_ts_sum
FROM dedup GROUP BY sn, fault_time_ts, label"""

ORACLES["message_intervals"] = f"""WITH {_EVENTS},
steps AS (
  SELECT sn, ord, time_ts, replace(raw_msg, '|', '') AS msg,
         lead(time_ts) OVER (PARTITION BY sn, replace(raw_msg, '|', '') ORDER BY time, ord) AS nxt
  FROM logs)
SELECT sn, ord, time_ts, msg, coalesce(nxt * 1000000, -1) AS next_us FROM steps
WHERE nxt IS NULL OR nxt > time_ts"""

ORACLES["fault_history_first40"] = f"""WITH {_history()}
SELECT sn, fault_time_ts, label, CAST(position AS INTEGER) AS position, time_ts, msg, server_model
FROM capped"""

ORACLES["train_fault_dedup"] = f"""WITH {_EVENTS}
SELECT sn, fault_time_ts, label FROM
  (SELECT * FROM all_faults UNION ALL SELECT * FROM all_faults) GROUP BY ALL"""

ORACLES["log_scalar_features"] = f"""WITH {_EVENTS},
m AS (SELECT ord, time, replace(raw_msg, '|', '') AS msg FROM logs)
SELECT ord, string_split(trim(msg), ' ')[1] AS category, {_CATEGORY_ID} AS category_id,
       CAST(len(string_split(msg, ' ')) AS INTEGER) AS word_cnt,
       CAST(length(msg) AS INTEGER) AS char_cnt, CAST(hour(time) AS INTEGER) AS log_hour
FROM m"""

ORACLES["category_last_mode"] = f"""WITH {_history()}
SELECT sn, fault_time_ts, label, last_category_id, mode_category_id, count(*) AS log_cnt,
       round(avg(CASE WHEN category_id = last_category_id THEN 1.0 ELSE 0.0 END), 6) AS last_category_occupy,
       round(avg(CASE WHEN category_id = mode_category_id THEN 1.0 ELSE 0.0 END), 6) AS mode_category_occupy,
       count(DISTINCT category_id) AS category_nunique
FROM flagged GROUP BY sn, fault_time_ts, label, last_category_id, mode_category_id"""

ORACLES["time_gap_features"] = f"""WITH {_history()}
SELECT sn, fault_time_ts, label, dup_log_cnt, min_time_ts, max_time_ts,
       fault_time_ts - min_time_ts AS dup_max_time_gap,
       round((fault_time_ts - min_time_ts) / dup_log_cnt, 6) AS dup_mean_time_gap,
       fault_time_ts - max_time_ts AS last_time_gap,
       CAST(hour(fault_time) AS INTEGER) AS fault_hour
FROM spans"""

ORACLES["scalar_features_v2"] = f"WITH {_V2} SELECT * FROM v2"
ORACLES["base_features_v2"] = f"""WITH {_V2}
SELECT v2.*, msg FROM v2 LEFT JOIN texts USING (sn, fault_time_ts, label)"""

ORACLES["merged_message_v2"] = f"WITH {_V2} SELECT * FROM texts"

_V1 = _history("raw_msg") + """,
texts AS (
  SELECT sn, fault_time, fault_time_ts, label, server_model,
         string_agg(msg, ' ' ORDER BY time, ord) AS msg
  FROM dedup WHERE server_model IS NOT NULL GROUP BY ALL),
per_fault AS (
  SELECT sn, fault_time_ts, label, last_category_id, mode_category_id, count(*) AS log_cnt,
         round(avg(CASE WHEN category_id = last_category_id THEN 1.0 ELSE 0.0 END), 6) AS last_category_occupy,
         round(avg(CASE WHEN category_id = mode_category_id THEN 1.0 ELSE 0.0 END), 6) AS mode_category_occupy,
         count(DISTINCT category_id) AS category_nunique,
         fault_time_ts - max(time_ts) AS last_time_gap,
         fault_time_ts - min(time_ts) AS max_time_gap,
         round((fault_time_ts - min(time_ts)) / count(*), 6) AS mean_time_gap,
         round(avg(word_cnt), 6) AS word_cnt, round(avg(char_cnt), 6) AS char_cnt,
         CAST(sum(word_cnt) AS DOUBLE) AS word_cnt_sum, CAST(sum(char_cnt) AS DOUBLE) AS char_cnt_sum
  FROM flagged GROUP BY sn, fault_time_ts, label, last_category_id, mode_category_id)"""

ORACLES["merged_message_v1"] = f"""WITH {_V1}
SELECT sn, fault_time_ts, label, server_model, msg FROM texts"""

ORACLES["base_features_v1"] = f"""WITH {_V1}
SELECT p.*, server_model, msg, CAST(hour(fault_time) AS INTEGER) AS fault_hour
FROM texts LEFT JOIN per_fault p USING (sn, fault_time_ts, label)"""

ORACLES["label_prior"] = f"""WITH {_EVENTS}
SELECT label, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 6) AS prior
FROM faults GROUP BY label"""

_ENCODING = _history() + """,
rows AS (SELECT DISTINCT sn, fault_time_ts, label, server_model FROM capped),
counted AS (
  SELECT server_model, count(*) AS cnt, count(DISTINCT sn) AS sn_cnt_of_server_model,
         count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1,
         count(*) FILTER (label = 2) AS n2, count(*) FILTER (label = 3) AS n3
  FROM rows WHERE server_model IS NOT NULL GROUP BY server_model),
prior AS (
  SELECT count(*) FILTER (label = 0) / count(*) AS q0, count(*) FILTER (label = 1) / count(*) AS q1,
         count(*) FILTER (label = 2) / count(*) AS q2, count(*) FILTER (label = 3) / count(*) AS q3
  FROM rows),
lifted AS (
  SELECT *, n0 / cnt / cnt / q0 AS l0, n1 / cnt / cnt / q1 AS l1,
            n2 / cnt / cnt / q2 AS l2, n3 / cnt / cnt / q3 AS l3
  FROM counted CROSS JOIN prior),
encoded AS (
  SELECT server_model, cnt, sn_cnt_of_server_model,
         round(n0 / cnt, 6) AS sm_encoding_0, round(n1 / cnt, 6) AS sm_encoding_1,
         round(n2 / cnt, 6) AS sm_encoding_2, round(n3 / cnt, 6) AS sm_encoding_3,
         round(l0 / (l0 + l1 + l2 + l3), 6) AS sm_encoding_weighted_0,
         round(l1 / (l0 + l1 + l2 + l3), 6) AS sm_encoding_weighted_1,
         round(l2 / (l0 + l1 + l2 + l3), 6) AS sm_encoding_weighted_2,
         round(l3 / (l0 + l1 + l2 + l3), 6) AS sm_encoding_weighted_3,
         round(l0 + l1 + l2 + l3, 6) AS sm_encoding_weighted_sum
  FROM lifted)"""

ORACLES["server_model_encoding"] = f"WITH {_ENCODING} SELECT * FROM encoded"
ORACLES["encoding_lookup"] = f"""WITH {_ENCODING}
SELECT ord, l.server_model, e.* EXCLUDE (server_model, sm_encoding_weighted_sum)
FROM logs l LEFT JOIN encoded e ON l.server_model = e.server_model"""

# --- text ---------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


def _grams(docs: str) -> str:
    """All n-grams of a table ``docs(doc_id, text)``, then the vocabulary."""
    return f"""
docs AS ({docs}),
toks AS (
  SELECT doc_id,
         list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                     lambda w: w NOT IN ({_STOP})) AS t
  FROM docs),
grams AS (
  SELECT doc_id, array_to_string(t[i : i + n - 1], ' ') AS term
  FROM (SELECT doc_id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i
        FROM toks, (SELECT unnest([1, 2, 3, 4]) AS n))),
top AS (
  SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM grams
  GROUP BY term ORDER BY tf DESC, term LIMIT 100),
vocabulary AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx, df,
         ln((1 + n_docs) / (1 + df)) + 1 AS idf, n_docs, tf
  FROM top, (SELECT count(*) AS n_docs FROM docs))"""


_DOCS = "SELECT doc_id, text FROM documents"
ORACLES["top_terms"] = f"WITH {_grams(_DOCS)} SELECT term, tf FROM vocabulary"
ORACLES["tfidf_vocabulary"] = f"""WITH {_grams(_DOCS)}
SELECT term, term_idx, df, round(idf, 6) AS idf, n_docs FROM vocabulary"""
ORACLES["tfidf_weights"] = f"""WITH {_grams(_DOCS)},
raw AS (
  SELECT doc_id, term_idx, count(*) * any_value(idf) AS w
  FROM grams JOIN vocabulary USING (term) GROUP BY doc_id, term_idx)
SELECT doc_id, term_idx,
       round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""
_FAULT_DOCS = "SELECT row_number() OVER () AS doc_id, msg AS text FROM texts"
ORACLES["fault_text_vocabulary"] = f"""WITH {_V2}, {_grams(_FAULT_DOCS)}
SELECT term, term_idx, df, round(idf, 6) AS idf, n_docs FROM vocabulary"""

# --- folds and weights ------------------------------------------------------------------------

_ROWS = "rows AS (SELECT vec_id AS row_id, label % 4 AS label, embedding FROM embeddings)"


def _ranked(keys: str, seed: int) -> str:
    """Rows with their position in the order of a hash of key and seed."""
    return f"""{_ROWS},
ranked AS (
  SELECT row_id, label, row_number() OVER ({keys} ORDER BY md5(row_id || '|' || {seed}), row_id) AS position FROM rows)"""


ORACLES["stratified_folds"] = f"""WITH {_ranked("PARTITION BY label", 2010)}
SELECT row_id, label, CAST((position - 1) % 5 AS INTEGER) AS fold FROM ranked"""
ORACLES["plain_folds"] = f"""WITH {_ranked("", 2016)}
SELECT row_id, label, CAST((position - 1) % 5 AS INTEGER) AS fold FROM ranked"""
ORACLES["stratified_holdout"] = f"""WITH {_ranked("PARTITION BY label", 2022)}
SELECT row_id, label, position <= round_even(count(*) OVER (PARTITION BY label) * 0.25, 0) AS is_validation FROM ranked"""
ORACLES["stratified_fold_sizes"] = f"""WITH {_ROWS},
counted AS (SELECT label, count(*) AS n FROM rows GROUP BY label)
SELECT label, CAST(fold AS INTEGER) AS fold, (n + 4 - fold) // 5 AS cnt
FROM counted, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) WHERE (n + 4 - fold) // 5 > 0"""
ORACLES["plain_fold_sizes"] = f"""WITH {_ROWS},
counted AS (SELECT count(*) AS n FROM rows)
SELECT CAST(fold AS INTEGER) AS fold, (n + 4 - fold) // 5 AS cnt
FROM counted, (SELECT unnest([0, 1, 2, 3, 4]) AS fold)"""
ORACLES["stratified_holdout_sizes"] = f"""WITH {_ROWS},
counted AS (SELECT label, count(*) AS n FROM rows GROUP BY label)
SELECT label, CAST(round_even(n * 0.25, 0) AS BIGINT) AS validation_cnt,
       n - CAST(round_even(n * 0.25, 0) AS BIGINT) AS training_cnt FROM counted"""
_WEIGHTS = f"""{_ROWS},
counted AS (SELECT label, count(*) AS cnt FROM rows GROUP BY label),
weights AS (
  SELECT label, cnt, round((SELECT sum(cnt) FROM counted) / (SELECT count(*) FROM counted) / cnt, 6) AS weight
  FROM counted)"""
ORACLES["class_weights"] = f"WITH {_WEIGHTS} SELECT * FROM weights"
ORACLES["row_class_weights"] = f"""WITH {_WEIGHTS}
SELECT row_id, label, weight FROM rows JOIN weights USING (label)"""
ORACLES["distinct_classes"] = f"WITH {_ROWS} SELECT DISTINCT label FROM rows"
ORACLES["min_max_scaled"] = f"""WITH {_ROWS},
cells AS (
  SELECT row_id, unnest(generate_series(0, len(embedding) - 1)) AS position,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM rows),
ranges AS (SELECT position, min(x) AS low, max(x) AS high FROM cells GROUP BY position)
SELECT row_id, CAST(position AS INTEGER) AS position,
       round(CASE WHEN high > low THEN (x - low) / (high - low) ELSE 0 END, 6) AS value
FROM cells JOIN ranges USING (position)"""

# --- scores -------------------------------------------------------------------------------------

_M = {"a": 0, "b": 4, "c": 8}
_LOGITS = ", ".join(
    f"CAST(embedding[{o + c + 1}] AS DOUBLE) * {LOGIT_SCALE} AS {m}{c}"
    for m, o in _M.items() for c in range(4)
)
_PROBS = ", ".join(
    f"exp({m}{c}) / (exp({m}0) + exp({m}1) + exp({m}2) + exp({m}3)) AS p{m}{c}"
    for m in _M for c in range(4)
)


def _first_max(cols: list[str]) -> str:
    """Index of the first largest of four expressions."""
    top = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {x} = {top} THEN {i}" for i, x in enumerate(cols)) + " END"


_SCORES = f"""logits AS (
  SELECT vec_id AS row_id, label % 4 AS target, CAST(vec_id % 5 AS INTEGER) AS fold, {_LOGITS}
  FROM embeddings),
probs AS (SELECT *, {_PROBS} FROM logits),
scored AS (SELECT *, {", ".join(
    f"{_first_max([f'p{m}{c}' for c in range(4)])} AS pred_{m}" for m in _M)} FROM probs)"""


def _cols(prefix: str = "pa", name: str = "p") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {name}{c}" for c in range(4))


ORACLES["softmax_probabilities"] = f"WITH {_SCORES} SELECT row_id, {_cols()} FROM scored"
ORACLES["sigmoid_one_hot"] = f"""WITH {_SCORES} SELECT row_id,
{", ".join(f"round(1 / (1 + exp(-a{c})), 6) AS s{c}" for c in range(4))},
{", ".join(f"CAST(target = {c} AS INTEGER) AS h{c}" for c in range(4))} FROM scored"""

_CLASS_COUNTS = """
counts AS (
  SELECT class, count(*) FILTER (target = class AND predict = class) AS tp,
         count(*) FILTER (target <> class AND predict = class) AS fp,
         count(*) FILTER (target = class AND predict <> class) AS fn
  FROM one, (SELECT unnest([0, 1, 2, 3]) AS class) GROUP BY class)"""
_ONE = f"{_SCORES}, one AS (SELECT target, pred_a AS predict FROM scored), {_CLASS_COUNTS}"
_F1 = "CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"


def _weighted(weights: str) -> str:
    return f"sum({_F1} * ({weights})[class + 1])"


_LIVE = "[5 / 11, 4 / 11, 1 / 11, 1 / 11]"
ORACLES["confusion_counts"] = f"WITH {_ONE} SELECT * FROM counts"
ORACLES["weighted_macro_f1"] = f"""WITH {_ONE}
SELECT round({_weighted(_LIVE)}, 6) AS macro_f1 FROM counts"""
ORACLES["weighted_macro_f1_alternative"] = f"""WITH {_ONE}
SELECT round({_weighted("[3 / 7, 2 / 7, 1 / 7, 1 / 7]")}, 6) AS macro_f1 FROM counts"""
ORACLES["prediction_counts"] = f"""WITH {_ONE}
SELECT CAST(predict AS INTEGER) AS predict, count(*) AS cnt FROM one GROUP BY predict"""


def _fold_scores(models: dict[str, str]) -> str:
    """Per fold and pooled scores of named class columns."""
    long = " UNION ALL ".join(
        f"SELECT '{name}' AS model, fold, target, {col} AS predict FROM ensemble"
        for name, col in models.items()
    )
    return f"""
long AS ({long}),
both_levels AS (
  SELECT * FROM long UNION ALL SELECT model, NULL AS fold, target, predict FROM long),
counts AS (
  SELECT model, fold, class, count(*) FILTER (target = class AND predict = class) AS tp,
         count(*) FILTER (target <> class AND predict = class) AS fp,
         count(*) FILTER (target = class AND predict <> class) AS fn
  FROM both_levels, (SELECT unnest([0, 1, 2, 3]) AS class) GROUP BY model, fold, class),
fold_scores AS (
  SELECT model, fold, {_weighted(_LIVE)} AS macro_f1 FROM counts GROUP BY model, fold)"""


_VOTE = "CAST(round_even((pred_a + pred_b + pred_c) / 3, 0) AS INTEGER)"
_BLENDS = {
    "blend_equal2": [f"0.5 * pa{c} + 0.5 * pb{c}" for c in range(4)],
    "blend_equal3": [f"(pa{c} + pb{c} + pc{c}) / 3" for c in range(4)],
    "blend_weighted": [f"0.4 * pa{c} + 0.4 * pb{c} + 0.2 * pc{c}" for c in range(4)],
}
_ENSEMBLE = f"""{_SCORES},
ensemble AS (SELECT *, {_VOTE} AS vote, {", ".join(
    f"{_first_max([f'({x})' for x in cols])} AS {name}" for name, cols in _BLENDS.items())}
  FROM scored)"""
_SINGLE = {m: f"pred_{m}" for m in _M}
_ALL = _SINGLE | {name: name for name in _BLENDS} | {"ordinal_vote": "vote"}

ORACLES["fold_scores"] = f"""WITH {_ENSEMBLE}, {_fold_scores(_SINGLE)}
SELECT model, coalesce(fold, -1) AS fold, round(macro_f1, 6) AS macro_f1 FROM fold_scores"""
ORACLES["blend_scoreboard"] = f"""WITH {_ENSEMBLE}, {_fold_scores(_ALL)}
SELECT model, coalesce(fold, -1) AS fold, round(macro_f1, 6) AS macro_f1 FROM fold_scores"""
ORACLES["fold_score_summary"] = f"""WITH {_ENSEMBLE}, {_fold_scores(_SINGLE)}
SELECT model, count(fold) AS folds,
       round(avg(macro_f1) FILTER (fold IS NOT NULL), 6) AS mean_score,
       round(stddev_pop(macro_f1) FILTER (fold IS NOT NULL), 6) AS std_score,
       round(max(macro_f1) FILTER (fold IS NULL), 6) AS oof_score
FROM fold_scores GROUP BY model"""
for _name, _parts in _BLENDS.items():
    _rounded = ", ".join(f"round({x}, 6) AS p{c}" for c, x in enumerate(_parts))
    ORACLES[_name] = f"""WITH {_ENSEMBLE}
SELECT row_id, {_rounded}, CAST({_name} AS INTEGER) AS predict FROM ensemble"""
ORACLES["ordinal_vote"] = f"""WITH {_ENSEMBLE}
SELECT row_id, CAST(vote AS DOUBLE) AS label FROM ensemble"""
ORACLES["fold_average"] = f"""WITH {_SCORES} SELECT row_id,
{", ".join(f"round((pa{c} + pb{c} + pc{c}) / 3, 6) AS p{c}" for c in range(4))} FROM scored"""
_SUMS = [f"(pa{c} + pb{c} + pc{c})" for c in range(4)]
ORACLES["fold_sum"] = f"""WITH {_SCORES} SELECT row_id,
{", ".join(f"round({s}, 6) AS p{c}" for c, s in enumerate(_SUMS))},
CAST({_first_max(_SUMS)} AS INTEGER) AS predict FROM scored"""

_SURE = f"""{_SCORES},
sure AS (
  SELECT row_id, pred_a AS label FROM scored
  WHERE (pred_a = 0 AND pa0 >= 0.8) OR (pred_a = 1 AND pa1 >= 0.8))"""
ORACLES["pseudo_label_select"] = f"""WITH {_SURE}
SELECT row_id, CAST(target AS INTEGER) AS label, 1 AS is_real FROM scored
UNION ALL SELECT row_id, CAST(label AS INTEGER), 0 FROM sure"""
ORACLES["pseudo_label_exclude"] = f"""WITH {_SURE}
SELECT row_id, target FROM scored WHERE row_id NOT IN (SELECT row_id FROM sure)"""

_CELLS = f"""{_SCORES},
cells AS (
  SELECT row_id, class, [a0, a1, a2, a3][class + 1] AS x,
         CASE WHEN target = class THEN 1.0 ELSE 0.0 END::DOUBLE AS t
  FROM scored, (SELECT unnest([0, 1, 2, 3]) AS class))"""


_MARGIN = f"""{_CELLS},
margins AS (SELECT row_id, class, 2 * t - 1 AS s, 0.75 * t + 0.25 * (1 - t) AS w, (2 * t - 1) * x AS z FROM cells),
parts AS (SELECT *, 1 / (1 + exp(-z)) AS p, 1 / (1 + exp(z)) AS q FROM margins)"""
ORACLES["focal_loss"] = f"""WITH {_MARGIN}
SELECT round(avg(-w * q * q * ln(p)), 6) AS focal_loss FROM parts"""
# derivatives of -w q^2 ln p by x, with p' = p q and q' = -p q
_GRAD = "round(s * w * (2 * p * q * q * ln(p) - q * q * q), 6) AS grad"
ORACLES["focal_gradient"] = f"""WITH {_MARGIN}
SELECT row_id, CAST(class AS INTEGER) AS class, {_GRAD} FROM parts"""
ORACLES["focal_grad_hess"] = f"""WITH {_MARGIN}
SELECT row_id, CAST(class AS INTEGER) AS class, {_GRAD},
       round(w * (2 * p * q * q * q * ln(p) - 4 * p * p * q * q * ln(p) + 2 * p * q * q * q + 3 * p * q * q * q), 6) AS hess
FROM parts"""
ORACLES["softmax_log_loss"] = f"""WITH {_SCORES}
SELECT round(avg(-ln([pa0, pa1, pa2, pa3][target + 1])), 6) AS log_loss FROM scored"""
ORACLES["extreme_logit_losses"] = f"""WITH {_CELLS},
margins AS (SELECT 0.75 * t + 0.25 * (1 - t) AS w, (2 * t - 1) * x * 1000 AS z FROM cells),
logs AS (SELECT w, -greatest(-z, 0) - ln(1 + exp(-abs(z))) AS lp, -greatest(z, 0) - ln(1 + exp(-abs(z))) AS lq
         FROM margins),
tops AS (SELECT row_id, max(x) * 1000 AS top, sum(x * t) * 1000 AS own FROM cells GROUP BY row_id),
sums AS (SELECT row_id, any_value(top) AS top, any_value(own) AS own, sum(exp(x * 1000 - top)) AS total
         FROM cells JOIN tops USING (row_id) GROUP BY row_id)
SELECT 'focal' AS loss, round(avg(-w * exp(2 * lq) * lp), 6) AS value FROM logs
UNION ALL SELECT 'softmax', round(avg(top + ln(total) - own), 6) FROM sums"""

ORACLES["ema_series"] = """WITH steps AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step,
         count(*) OVER (PARTITION BY user_id) AS steps FROM events)
SELECT user_id, any_value(steps) AS steps,
       round(sum(0.1 * pow(0.9, steps - step) * value), 6) AS ema
FROM steps GROUP BY user_id"""

# --- first round of softmax boosting -------------------------------------------------------------

_BINNED = """rows AS (
  SELECT vec_id AS row_id, label % 4 AS label, embedding::DOUBLE[] AS e FROM embeddings),
weighted AS (
  SELECT *, (SELECT count(*) FROM rows) / (SELECT count(DISTINCT label) FROM rows)
            / count(*) OVER (PARTITION BY label) AS w FROM rows),
x AS (SELECT row_id, label, w, unnest(range(len(e))) AS feature, unnest(e) AS v FROM weighted),
edges AS (
  SELECT feature, list_distinct(quantile_disc(v, list_transform(range(1, 64), lambda i: i / 64))) AS edges
  FROM x GROUP BY feature),
placed AS (
  SELECT label, w, feature, len(list_filter(edges, lambda q: q < v)) AS bin FROM x JOIN edges USING (feature))"""
# margins start at 0, so every class has probability 1/4; the hessian's factor is 2
_FIRST = f"""{_BINNED}, cells AS (
  SELECT class, feature, bin, count(*) AS n, sum(w * (0.25 - (label = class)::INT)) AS g,
         sum(w * 2 * 0.25 * 0.75) AS h
  FROM placed, (SELECT unnest(range(4)) AS class) GROUP BY ALL)"""
ORACLES["boost_histogram"] = f"""WITH {_FIRST}
SELECT class::INT AS class, feature::INT AS feature, bin::INT AS bin, n, round(g, 9) AS g, round(h, 9) AS h FROM cells"""


def _best_cut(order: str, left: str, l1: float, min_rows: int, min_hessian: float) -> str:
    """The best prefix of ``order`` of every class, from the table ``cells``; l2 is 10."""
    def worth(g: str, h: str) -> str:
        return f"(power(greatest(abs({g}) - {l1}, 0), 2) / ({h} + 10))"

    return f"""prefixes AS (
  SELECT *, sum(n) OVER before AS nl, sum(g) OVER before AS gl, sum(h) OVER before AS hl,
         sum(n) OVER whole AS nn, sum(g) OVER whole AS gg, sum(h) OVER whole AS hh,
         list(bin) OVER before AS bins
  FROM cells WINDOW before AS (PARTITION BY class, feature ORDER BY {order} ROWS UNBOUNDED PRECEDING),
                    whole AS (PARTITION BY class, feature)
), gains AS (
  SELECT *, {worth('gl', 'hl')} + {worth('gg - gl', 'hh - hl')} - {worth('gg', 'hh')} AS gain FROM prefixes
  WHERE nl >= {min_rows} AND nn - nl >= {min_rows} AND hl >= {min_hessian} AND hh - hl >= {min_hessian}
), best AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(gain, 9) DESC, feature, nl) AS place FROM gains
)
SELECT class::INT AS class, feature::INT AS feature, {left} AS "left", round(gain, 6) AS gain, nn::BIGINT AS n,
       round(gg, 6) AS g, round(hh, 6) AS h FROM best WHERE place = 1"""


ORACLES["boost_first_splits"] = f"""WITH {_FIRST},
{_best_cut('bin', "array_to_string(range(bin + 1), ',')", 0, 1, 1.5)}"""

_FAULT_CATEGORIES = f"cats AS ({ORACLES['category_last_mode']})"
# margins start at the log shares of the classes; the hessian's factor is 4/3
ORACLES["boost_category_split"] = f"""WITH {_FAULT_CATEGORIES},
shares AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM cats GROUP BY label),
x AS (
  SELECT label, 0 AS feature, last_category_id AS bin FROM cats
  UNION ALL SELECT label, 1, mode_category_id FROM cats),
cells AS (
  SELECT s.label AS class, feature, bin, count(*) AS n, sum(p - (x.label = s.label)::INT) AS g,
         sum(greatest(4.0 / 3 * p * (1 - p), 1e-16)) AS h
  FROM x, shares s GROUP BY ALL),
{_best_cut('g / (h + 10), bin', "array_to_string(list_sort(bins), ',')", 1, 20, 5)}"""

ORACLES["ordered_statistics"] = f"""WITH {_FAULT_CATEGORIES},
placed AS (
  SELECT sn, fault_time_ts, label, last_category_id, mode_category_id,
         md5(concat_ws('|', sn, fault_time_ts, label, last_category_id, mode_category_id, '2022')) AS spot FROM cats)
SELECT sn, fault_time_ts, label, last_category_id, mode_category_id, {", ".join(
    f"round((coalesce(sum((label = {c})::INT) OVER earlier, 0) + 0.25) / (count(*) OVER earlier + 1), 6) AS s{c}"
    for c in range(4))}
FROM placed WINDOW earlier AS (PARTITION BY last_category_id ORDER BY spot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
                               EXCLUDE GROUP)"""

# --- stored artifacts ---------------------------------------------------------------------------

ORACLES["features_stored"] = f"""SELECT sn, fault_time_ts, server_model, label, last_category_id, mode_category_id,
       last_time_gap, last_category_occupy, mode_category_occupy, category_nunique, fault_hour, dup_log_cnt,
       dup_max_time_gap, dup_mean_time_gap, word_cnt_mean, char_cnt_mean
FROM ({ORACLES['scalar_features_v2']})"""
ORACLES["encoding_stored"] = ORACLES["server_model_encoding"]
ORACLES["tfidf_stored"] = ORACLES["tfidf_vocabulary"]
