"""The registered queries in SQL, for a check by another engine on the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

FLOWS = """
flows AS (
  SELECT event_id, value,
         CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS label_tactic
  FROM events),
task_map(task, kind, label_tactic, label) AS (VALUES
  ('click', 'binary', 'none', 0.0::DOUBLE), ('click', 'binary', 'click', 1.0),
  ('error', 'binary', 'none', 0.0), ('error', 'binary', 'error', 1.0),
  ('purchase', 'binary', 'none', 0.0), ('purchase', 'binary', 'purchase', 1.0),
  ('signup', 'binary', 'none', 0.0), ('signup', 'binary', 'signup', 1.0),
  ('Multinomial', 'multinomial', 'none', 0.0), ('Multinomial', 'multinomial', 'click', 1.0),
  ('Multinomial', 'multinomial', 'error', 2.0), ('Multinomial', 'multinomial', 'purchase', 3.0),
  ('Multinomial', 'multinomial', 'signup', 4.0)),
tasks AS (SELECT f.*, m.task, m.kind, m.label FROM flows f JOIN task_map m USING (label_tactic))
"""


def md5_hash(key: str) -> str:
    return f"('0x' || substr(md5({key} || '|42'), 1, 15))::BIGINT"


def side(key: str) -> str:
    return f"CASE WHEN {md5_hash(key)} % 10000 < 7000 THEN 'train' ELSE 'test' END"


# --- sources -------------------------------------------------------------------------------

ORACLES["class_census"] = """
SELECT event_type AS label_tactic, count(*)::BIGINT AS n FROM events GROUP BY 1"""

TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)
ORACLES["file_census"] = " UNION ALL ".join(
    f"SELECT '{name}.parquet' AS file, count(*)::BIGINT AS rows FROM {name}" for name in TABLES
)

_LABELS = {
    "conversations": "role", "documents": "lang", "events": "event_type",
    "lineitem": "l_returnflag", "orders": "o_orderstatus",
}
ORACLES["multi_dataset_census"] = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, {label} AS label_tactic, count(*)::BIGINT AS n"
    f" FROM {name} GROUP BY 2"
    for name, label in _LABELS.items()
)
ORACLES["census_ledger"] = f"SELECT *, 0 AS opened_again FROM ({ORACLES['multi_dataset_census']})"
ORACLES["chart_counts"] = ORACLES["multi_dataset_census"]

ORACLES["inventory_validation"] = """
WITH expected(dataset, files, rows) AS (VALUES ('events', 1, 10000), ('orders', 2, 15000)),
expected_classes(dataset, label, n) AS (VALUES ('events', 'view', 2000), ('events', 'click', 2000),
  ('orders', 'F', 4933), ('orders', 'O', 4979), ('orders', 'P', 5088)),
classes AS (
  SELECT 'events' AS dataset, event_type AS label, count(*) AS n FROM events GROUP BY 2
  UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY 2),
actual AS (SELECT dataset, 1 AS files, sum(n)::BIGINT AS rows FROM classes GROUP BY 1),
differing AS (
  SELECT DISTINCT coalesce(c.dataset, e.dataset) AS dataset
  FROM classes c FULL JOIN expected_classes e ON c.dataset = e.dataset AND c.label = e.label
  WHERE c.n IS DISTINCT FROM e.n)
SELECT dataset, 'files' AS problem,
       'files: expected ' || e.files || ', found ' || a.files AS message
FROM expected e JOIN actual a USING (dataset) WHERE e.files <> a.files
UNION ALL
SELECT dataset, 'rows', 'rows: expected ' || e.rows || ', found ' || a.rows
FROM expected e JOIN actual a USING (dataset) WHERE e.rows <> a.rows
UNION ALL
SELECT dataset, 'classes', 'label_tactic counts do not match the paper dataset' FROM differing"""

_FILES = "(VALUES ('events'), ('orders')) AS f(dataset)"
ORACLES["inventory"] = (
    ORACLES["inventory_validation"].replace("\nSELECT dataset, 'files' AS problem,", """, problems AS (
SELECT dataset, 'files' AS problem,""")
    + f"""
)
SELECT dataset, label AS item, n FROM (
  SELECT dataset, 'class ' || label AS label, n::BIGINT AS n FROM classes
  UNION ALL SELECT dataset, 'files', 1 FROM {_FILES}
  UNION ALL SELECT dataset, 'schemas', 1 FROM {_FILES}
  UNION ALL SELECT dataset, 'rows', rows FROM actual
  UNION ALL SELECT dataset, message, NULL FROM problems)"""
)

# --- tasks, samples, splits ----------------------------------------------------------------

ORACLES["task_frame_binary"] = f"""
WITH {FLOWS} SELECT event_id, label_tactic, label FROM tasks WHERE task = 'click'"""

ORACLES["task_frames"] = f"""
WITH {FLOWS} SELECT event_id, task, kind, label_tactic, label FROM tasks"""

ORACLES["class_cap"] = f"""
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type
  ORDER BY {md5_hash("event_id::VARCHAR")}, event_id::VARCHAR) <= 500"""

_LINE_KEY = "l_orderkey || '|' || l_linenumber"
_LINE_TIE = "l_partkey || '|' || l_suppkey"
_LINE_ORDER = (
    f"{md5_hash(_LINE_KEY)}, {_LINE_KEY}, {md5_hash(_LINE_TIE)},"
    " l_orderkey, l_linenumber, l_partkey, l_suppkey"
)
_LINE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag"
ORACLES["class_cap_cutoff"] = f"""
SELECT {_LINE_COLUMNS} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {_LINE_ORDER}) <= 7000"""

_HOT_TIE = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"
ORACLES["class_cap_hot_key"] = f"""
SELECT {_LINE_COLUMNS} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {md5_hash(_HOT_TIE)},
  l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 9000"""


_NULLED = "CASE WHEN event_id % 5 >= 2 THEN event_id END"
_NULL_ORDER = (
    f"""{md5_hash(f"coalesce(({_NULLED})::VARCHAR, '')")}, ({_NULLED})::VARCHAR NULLS FIRST,"""
    f" {md5_hash('event_id::VARCHAR')}, event_id"
)
ORACLES["class_cap_null_key"] = f"""
WITH kept AS (
  SELECT {_NULLED} AS key, event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_NULL_ORDER}) <= 700)
SELECT *, unnest(['window', 'cutoff']) AS strategy FROM kept"""


def allotted(counts: str, by: str, label: str, cut: str, protected: str) -> str:
    """CTEs that end in ``quotas``."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
counts AS ({counts}),
sized AS (
  SELECT *, CASE WHEN {label} = '{protected}' THEN 0 ELSE n END AS open_n FROM counts),
goal AS (
  SELECT *, sum(open_n) OVER ({part}) AS open_all,
         greatest(0, greatest(1, round_even(sum(n) OVER ({part}) * (1 - {cut}::DOUBLE), 0))::BIGINT
           - (sum(n) OVER ({part}) - sum(open_n) OVER ({part}))) AS places FROM sized),
based AS (SELECT *, least(open_n, (places * open_n) // greatest(open_all, 1)) AS base FROM goal),
spare AS (
  SELECT *, places - sum(base) OVER ({part}) AS rest, open_n - base AS room,
         coalesce(sum(open_n - base) OVER ({part} ORDER BY open_n DESC, {label}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM based),
quotas AS (
  SELECT {by + "," if by else ""} {label}, n,
         (CASE WHEN {label} = '{protected}' THEN n
               ELSE base + greatest(0, least(room, rest - ahead)) END)::BIGINT AS quota
  FROM spare)"""


_TASK_QUOTAS = allotted(
    "SELECT task, label_tactic, count(*)::BIGINT AS n FROM tasks GROUP BY 1, 2",
    "task", "label_tactic", "0.9", "purchase",
)
ORACLES["quota_allocation"] = f"""
WITH {FLOWS}, {_TASK_QUOTAS} SELECT task, label_tactic, n, quota FROM quotas"""

ORACLES["sample_metadata"] = f"""
WITH {FLOWS}, {_TASK_QUOTAS}
SELECT task, 'paper-reported-reduction' AS policy, 0.9::DOUBLE AS reported_reduction,
       sum(n)::BIGINT AS source_rows, sum(quota)::BIGINT AS target_rows,
       bool_and(label_tactic <> 'purchase' OR quota = n) AS protected_retained,
       '{{' || string_agg('"' || label_tactic || '":' || quota, ',' ORDER BY label_tactic) || '}}'
         AS target_class_counts
FROM quotas GROUP BY task"""

_LINE_QUOTAS = allotted(
    "SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1",
    "", "l_returnflag", "0.85", "A",
)
ORACLES["quota_sample"] = f"""
WITH {_LINE_QUOTAS},
ranked AS (
  SELECT {_LINE_COLUMNS},
         row_number() OVER (PARTITION BY l_returnflag ORDER BY {_LINE_ORDER}) AS place
  FROM lineitem)
SELECT {_LINE_COLUMNS} FROM ranked JOIN quotas USING (l_returnflag) WHERE place <= quota"""

ORACLES["stratified_split"] = f"""
SELECT {_LINE_COLUMNS}, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY {_LINE_ORDER})
    <= count(*) OVER (PARTITION BY l_returnflag) * 7 // 10 THEN 'train' ELSE 'test' END AS split
FROM lineitem"""
ORACLES["stratified_split_hot_key"] = f"""
SELECT {_LINE_COLUMNS}, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY {md5_hash(_HOT_TIE)},
    l_orderkey, l_linenumber, l_partkey, l_suppkey)
    <= count(*) OVER (PARTITION BY l_returnflag) * 7 // 10 THEN 'train' ELSE 'test' END AS split
FROM lineitem"""
_CONTENT = "l_returnflag, l_linestatus, l_linenumber, l_quantity"
_CONTENT_KEY = " || '|' || ".join(f"'=' || {c}" for c in (*_CONTENT.split(", "), "copy"))
ORACLES["content_split"] = f"""
WITH numbered AS (
  SELECT {_CONTENT}, row_number() OVER (PARTITION BY ALL) AS copy
  FROM (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity::INT AS l_quantity FROM lineitem))
SELECT {_CONTENT}, {side(_CONTENT_KEY)} AS split FROM numbered""".replace("PARTITION BY ALL", f"PARTITION BY {_CONTENT}")

ORACLES["growing_cap"] = ORACLES["class_cap_cutoff"]
ORACLES["growing_quota"] = ORACLES["quota_sample"]

ORACLES["hash_split"] = f"""
SELECT l_orderkey, l_linenumber, {side(_LINE_KEY)} AS split FROM lineitem"""

ORACLES["class_counts_by_split"] = f"""
WITH {FLOWS}
SELECT task, {side("event_id::VARCHAR")} AS split, label_tactic, count(*)::BIGINT AS n
FROM tasks GROUP BY ALL"""

ORACLES["random_split"] = """
SELECT event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids, true AS share_in_range
FROM events GROUP BY 1"""

# --- features ------------------------------------------------------------------------------

ORACLES["feature_projection"] = """
SELECT event_id, event_type, epoch(ts)::DOUBLE AS __value_ts, user_id::DOUBLE AS __value_user_id,
       value AS __value_value,
       CASE WHEN trim(props) = '' THEN '__MISSING__' ELSE props END AS __value_props
FROM events"""

ORACLES["blank_handling"] = """
WITH blanked AS (
  SELECT lang, coalesce(CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '  ' ELSE lang END, '') AS legacy
  FROM documents)
SELECT lang, legacy, CASE WHEN trim(legacy) = '' THEN '__MISSING__' ELSE legacy END AS corrected,
       count(*)::BIGINT AS n
FROM blanked GROUP BY ALL"""

ORACLES["impute_and_scale"] = """
WITH given AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax,
         CASE WHEN l_discount > 0 THEN l_quantity END AS quantity FROM lineitem),
filled AS (
  SELECT * REPLACE (coalesce(quantity, (SELECT avg(quantity) FROM given)) AS quantity) FROM given),
stats AS (
  SELECT avg(quantity) qm, stddev_samp(quantity) qs, avg(l_extendedprice) pm,
         stddev_samp(l_extendedprice) ps, avg(l_tax) tm, stddev_samp(l_tax) ts FROM filled)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((quantity - qm) / qs, 6) AS quantity,
       round((l_extendedprice - pm) / ps, 6) AS l_extendedprice,
       round((l_tax - tm) / ts, 6) AS l_tax
FROM filled, stats"""


def indexed(source: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", {column} AS value, count(*)::BIGINT AS n,"
        f" (row_number() OVER (ORDER BY count(*) DESC, {column}) - 1)::BIGINT AS index"
        f" FROM {source} GROUP BY {column}"
    )


ORACLES["string_index"] = " UNION ALL ".join(
    f"({indexed('part', c)})" for c in ("p_name", "p_brand", "p_type")
)

ORACLES["index_lookup"] = f"""
WITH small AS (SELECT * FROM part WHERE p_size <= 10), idx AS ({indexed("small", "p_name")})
SELECT p_partkey, p_name, p_size,
       coalesce(idx.index, (SELECT count(*) FROM idx))::DOUBLE AS name_index
FROM part LEFT JOIN idx ON p_name = idx.value"""

ORACLES["one_hot"] = f"""
WITH idx AS ({indexed("part", "p_brand")})
SELECT p_partkey, idx.index AS slot, (SELECT count(*) + 1 FROM idx)::BIGINT AS width
FROM part JOIN idx ON p_brand = idx.value"""

ORACLES["unseen_categories"] = f"""
WITH sides AS (SELECT *, {side("c_custkey::VARCHAR")} AS split FROM customer),
train AS (SELECT * FROM sides WHERE split = 'train'),
test AS (SELECT * FROM sides WHERE split = 'test')
SELECT 'c_name' AS "column", count(*)::BIGINT AS rows FROM test
WHERE c_name NOT IN (SELECT c_name FROM train)
UNION ALL
SELECT 'c_mktsegment', count(*)::BIGINT FROM test
WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM train)"""

ORACLES["unseen_by_filter"] = ORACLES["unseen_categories"]

ORACLES["hash_load"] = """
WITH d AS (
  SELECT count(DISTINCT c_name) AS a, count(DISTINCT c_mktsegment) AS b FROM customer)
SELECT '{"c_mktsegment":' || b || ',"c_name":' || a || '}' AS distinct_values,
       (a + b)::BIGINT AS total_distinct, 256 AS buckets,
       greatest(0, a + b - 256)::BIGINT AS minimum_collisions, (a + b) / 256.0::DOUBLE AS load_factor
FROM d"""



def murmur3(text: str) -> str:
    """Murmur3 with seed 42 of the UTF-8 bytes of a text, as an unsigned number."""

    def times(a: str, factor: int) -> str:
        return f"((({a}) * {factor & 0xFFFF} + (((({a}) * {factor >> 16}) & 65535) << 16)) & 4294967295)"

    def turned(a: str, bits: int) -> str:
        return f"(((({a}) << {bits}) & 4294967295) | (({a}) >> {32 - bits}))"

    def shifted(a: str, bits: int) -> str:
        return f"xor({a}, ({a}) >> {bits})"

    mixed = times(turned(times("k", 0xCC9E2D51), 15), 0x1B873593)
    body = f"(({times(turned(f'xor(h, {mixed})', 13), 5)} + {0xE6546B64}) & 4294967295)"
    word = "('0x' || " + " || ".join(f"substr(own, {at}, 2)" for at in (7, 5, 3, 1)) + ")::BIGINT"
    return f"""
  WITH digits AS (SELECT {text} AS text, hex(encode({text})) AS digits, strlen({text}) AS len FROM counted),
  words AS (
    SELECT text, len, list_transform(
      list_transform(range((len + 3) // 4), lambda i: rpad(substr(digits, (8 * i + 1)::INT, 8), 8, '0')),
      lambda own: {word}) AS words FROM digits),
  bodies AS (
    SELECT text, len, words, list_reduce(list_prepend(42::BIGINT, list_slice(words, 1, len // 4)),
      lambda h, k: {body}) AS h FROM words),
  tails AS (
    SELECT text, len, CASE WHEN len % 4 > 0 THEN xor(h, {mixed.replace("k", "words[len // 4 + 1]")}) ELSE h END AS h
    FROM bodies),
  m1 AS (SELECT text, xor(h, len) AS h FROM tails),
  m2 AS (SELECT text, {times(shifted("h", 16), 0x85EBCA6B)} AS h FROM m1),
  m3 AS (SELECT text, {times(shifted("h", 13), 0xC2B2AE35)} AS h FROM m2)
  SELECT text, {shifted("h", 16)} AS h FROM m3"""


ORACLES["hash_collisions"] = f"""
WITH counted AS (
  SELECT 'c_name' AS "column", c_name AS value, count(*) AS rows FROM customer WHERE c_name IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ALL),
hashed AS ({murmur3("\"column\" || '=' || value")}),
slotted AS (
  SELECT (h % 256)::INT AS slot, "column", value, rows
  FROM counted JOIN hashed ON text = "column" || '=' || value)
SELECT *, count(*) OVER (PARTITION BY slot) AS slot_values, (sum(rows) OVER (PARTITION BY slot))::BIGINT AS slot_rows
FROM slotted QUALIFY slot_values > 1"""

ORACLES["feature_vectors"] = f"""
WITH sides AS (
  SELECT o_orderkey, o_custkey::DOUBLE AS f0, o_totalprice AS f1, epoch(o_orderdate)::DOUBLE AS f2,
         o_orderpriority, {side("o_orderkey::VARCHAR")} AS split FROM orders),
train AS (SELECT * FROM sides WHERE split = 'train'), idx AS ({indexed("train", "o_orderpriority")}),
coded AS (
  SELECT s.*, {", ".join(f"(idx.index = {i})::INT::DOUBLE AS f{i + 3}" for i in range(5))}
  FROM sides s LEFT JOIN idx ON s.o_orderpriority = idx.value),
stats AS (
  SELECT {", ".join(f"avg(f{i}) AS m{i}, stddev_samp(f{i}) AS s{i}" for i in range(8))}
  FROM coded WHERE split = 'train')
SELECT o_orderkey, {", ".join(f"round((f{i} - m{i}) / s{i}, 6) AS f{i}" for i in range(8))},
       0.0::DOUBLE AS f8
FROM coded, stats WHERE split = 'test'"""

# --- metrics -------------------------------------------------------------------------------

_PREDICTED = f"""{FLOWS},
predicted AS (
  SELECT *, CASE WHEN kind = 'binary' THEN (value > 20)::INT::DOUBLE
                 ELSE least(floor(value / 15), 4)::DOUBLE END AS prediction FROM tasks)"""


def counted(source: str, by: str, labels: str) -> str:
    """CTEs ``cells`` and ``classes`` over ``source`` with labels per identity in ``labels``."""
    on = " AND ".join(f"x.{c} IS NOT DISTINCT FROM a.{c}" for c in by.split(", "))
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM a.{c}" for c in by.split(", "))
    ids = ", ".join(f"a.{c}" for c in by.split(", "))
    return f"""
cells AS (
  SELECT {ids}, a.label, p.label AS prediction, count(x.label)::BIGINT AS n
  FROM {labels} a JOIN {labels} p ON {same}
  LEFT JOIN {source} x ON {on} AND x.label = a.label AND x.prediction = p.label
  GROUP BY ALL),
sums AS (
  SELECT {by}, c AS label, sum(n) FILTER (label = c) AS support,
         sum(n) FILTER (prediction = c) AS predicted_support,
         sum(n) FILTER (label = c AND prediction = c) AS tp, sum(n) AS total
  FROM (SELECT *, unnest([0.0, 1.0, 2.0, 3.0, 4.0]::DOUBLE[]) AS c FROM cells)
  GROUP BY ALL HAVING count(*) FILTER (label = c) > 0),
rates AS (
  SELECT {by}, label, support, predicted_support, tp, predicted_support - tp AS fp,
         support - tp AS fn, total - support - predicted_support + tp AS tn, total,
         CASE WHEN predicted_support > 0 THEN tp / predicted_support ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM sums),
classes AS (
  SELECT *, CASE WHEN precision + recall > 0
                 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
         CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr FROM rates)"""


_TASK_LABELS = "labels_of AS (SELECT DISTINCT task, label FROM task_map)"
_RULE = f"WITH {_PREDICTED}, {_TASK_LABELS}, {counted('predicted', 'task', 'labels_of')}"

ORACLES["confusion_matrix"] = f"{_RULE} SELECT task, label, prediction, n FROM cells"

ORACLES["confusion_nested"] = f"""{_RULE},
lines AS (
  SELECT task, label, '[' || string_agg(n::VARCHAR, ',' ORDER BY prediction) || ']' AS line,
         sum(n)::BIGINT AS support FROM cells GROUP BY 1, 2)
SELECT task, '[' || string_agg(line, ',' ORDER BY label) || ']' AS matrix,
       '[' || string_agg(support::VARCHAR, ',' ORDER BY label) || ']' AS supports
FROM lines GROUP BY 1"""

ORACLES["per_class_metrics"] = f"""{_RULE}
SELECT task, label, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall,
       round(f1, 6)::DOUBLE AS f1, round(fpr, 6)::DOUBLE AS fpr, support::BIGINT AS support,
       predicted_support::BIGINT AS predicted_support, tp::BIGINT AS tp, fp::BIGINT AS fp,
       fn::BIGINT AS fn, tn::BIGINT AS tn FROM classes"""


def summed(by: str) -> str:
    """Select list of the summary metrics, unrounded."""
    weighted = ", ".join(
        f"sum({m} * support) / greatest(sum(support), 1) AS weighted_{m}"
        for m in ("precision", "recall", "f1", "fpr")
    )
    macro = ", ".join(f"avg({m}) AS macro_{m}" for m in ("precision", "recall", "f1"))
    attack = ", ".join(
        f"max({m}) FILTER (label = 1) AS attack_{m}" for m in ("precision", "recall", "f1", "fpr")
    )
    return (
        f"{by}, sum(tp) / greatest(sum(support), 1) AS accuracy, {weighted}, {macro}, {attack},"
        " bool_or(support > 0 AND (predicted_support = 0 OR recall = 0)) AS collapse_flag,"
        " '{' || string_agg('\"' || label || '\":' || predicted_support::BIGINT, ','"
        " ORDER BY label::VARCHAR) || '}' AS predicted_support_json,"
        " sum(support)::BIGINT AS test_rows"
    )


_METRICS = (
    "accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "weighted_fpr",
    "macro_precision", "macro_recall", "macro_f1", "attack_precision", "attack_recall",
    "attack_f1", "attack_fpr",
)
ORACLES["metric_summary"] = f"""{_RULE},
summary AS (SELECT {summed("task")} FROM classes GROUP BY task)
SELECT task, {", ".join(f"round({m}, 6)::DOUBLE AS {m}" for m in _METRICS)},
       predicted_support_json, test_rows FROM summary"""

ORACLES["collapse_and_validity"] = f"""
WITH {_PREDICTED}, {_TASK_LABELS},
changed AS (
  SELECT * REPLACE (CASE WHEN task = 'error' THEN 0.0 ELSE prediction END AS prediction)
  FROM predicted WHERE NOT (task = 'signup' AND label_tactic = 'signup')),
{counted("changed", "task", "labels_of")},
judged AS (
  SELECT *, support > 0 AND (predicted_support = 0 OR recall = 0) AS collapsed FROM classes),
texts AS (
  SELECT task, string_agg(label::VARCHAR, ', ' ORDER BY label) FILTER (collapsed) AS gone,
         string_agg(label::VARCHAR, ', ' ORDER BY label) FILTER (support = 0) AS absent,
         sum(support)::BIGINT AS test_rows FROM judged GROUP BY task)
SELECT task, gone IS NOT NULL AS collapse_flag,
       coalesce('zero predictions or recall for supported labels: ' || gone, '') AS collapse_reason,
       absent IS NULL AS evaluation_valid,
       coalesce('no test support for labels: ' || absent, '') AS evaluation_warning, test_rows
FROM texts"""


def rank_sum(source: str, by: str) -> str:
    """AUROC per ``by`` of rows ``(by, score, hit)`` by mid-ranks."""
    return f"""
ranked AS (
  SELECT {by}, hit, rank() OVER (PARTITION BY {by} ORDER BY score)
         + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS mid FROM {source}),
areas AS (
  SELECT {by}, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS q,
         sum(mid) FILTER (hit) AS r FROM ranked GROUP BY {by}),
scored_areas AS (
  SELECT {by}, p::BIGINT AS positives, q::BIGINT AS negatives,
         CASE WHEN p > 0 AND q > 0 THEN (r - p * (p + 1) / 2.0) / (p::DOUBLE * q) END AS auroc
  FROM areas)"""


ORACLES["auroc_binary"] = f"""
WITH {FLOWS},
scored AS (SELECT task, value AS score, label = 1 AS hit FROM tasks WHERE kind = 'binary'),
{rank_sum("scored", "task")}
SELECT task, positives, negatives, round(auroc, 9)::DOUBLE AS auroc FROM scored_areas"""

ORACLES["auroc_interval"] = f"SELECT task, auroc, TRUE AS held, TRUE AS narrow FROM ({ORACLES['auroc_binary']})"

ORACLES["auroc_skewed_scores"] = f"""
WITH scored AS (
  SELECT l_linestatus, CASE WHEN l_quantity <= 17 THEN 0 ELSE l_discount END AS score,
         l_returnflag = 'R' AS hit FROM lineitem),
{rank_sum("scored", "l_linestatus")}
SELECT l_linestatus, positives, negatives, round(auroc, 9)::DOUBLE AS auroc FROM scored_areas"""

_SLOTS = """
slots AS (
  SELECT label, unnest([list_max(list_transform(range(slot, 64, 10), lambda i: embedding[i + 1]::DOUBLE))
                        for slot in range(10)]) AS score, unnest(range(10)) AS slot FROM embeddings),
scored AS (SELECT slot::DOUBLE AS class_label, score, label = slot AS hit FROM slots)"""
ORACLES["auroc_by_class"] = f"""
WITH {_SLOTS}, {rank_sum("scored", "class_label")}
SELECT class_label, positives, negatives, round(auroc, 9)::DOUBLE AS auroc FROM scored_areas"""
ORACLES["auroc_weighted"] = f"""
WITH {_SLOTS}, {rank_sum("scored", "class_label")}
SELECT round(sum(auroc * positives) / sum(positives), 9)::DOUBLE AS auroc FROM scored_areas"""

# --- reductions ----------------------------------------------------------------------------

_LABEL = "CASE l_returnflag WHEN 'N' THEN 0.0::DOUBLE WHEN 'A' THEN 1.0 ELSE 2.0 END"
ORACLES["class_moments"] = f"""
SELECT {_LABEL} AS label, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean0,
       round(avg(l_discount), 6) AS mean1, round(avg(l_tax), 6) AS mean2
FROM lineitem GROUP BY 1"""

_COLUMNS3 = ("l_quantity", "l_discount", "l_tax")
ORACLES["class_scatter"] = " UNION ALL ".join(
    f"SELECT {i} AS line, "
    + ", ".join(f"round(sum(s{i}{j}), 4) AS c{j}" for j in range(3))
    + " FROM (SELECT "
    + ", ".join(
        f"covar_samp({a}, {b}) * (count(*) - 1) AS s{i}{j}" for j, b in enumerate(_COLUMNS3)
    )
    + " FROM lineitem GROUP BY l_returnflag)"
    for i, a in enumerate(_COLUMNS3)
)

# eigenvalues of a symmetric 2 x 2 matrix in closed form
_SPREAD2 = """
moments AS (
  SELECT var_samp(l_quantity) AS a, var_samp(l_linenumber) AS c,
         covar_samp(l_quantity, l_linenumber) AS b FROM lineitem),
eigen AS (
  SELECT unnest([1, 2]) AS component,
         unnest([(a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b),
                 (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b)]) AS variance FROM moments)"""
ORACLES["pca_variance"] = f"""
WITH {_SPREAD2}, shares AS (
  SELECT component, variance / sum(variance) OVER () AS share FROM eigen)
SELECT component, round(share, 6) AS explained_variance,
       round(sum(share) OVER (ORDER BY component), 6) AS cumulative_variance FROM shares"""
ORACLES["pca_spread"] = f"""
WITH {_SPREAD2} SELECT component, round(variance, 6) AS variance FROM eigen"""

ORACLES["pca_total_spread"] = """
WITH slots AS (
  SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
spread AS (SELECT i, var_samp(x) AS v FROM slots GROUP BY i)
SELECT count(*)::BIGINT AS components, round(sum(v), 6) AS variance FROM spread"""


def scatter2(label: str) -> str:
    """Within- and between-class scatter of two features, and the inverse of the former."""
    return f"""
rows AS (SELECT {label} AS label, l_quantity AS x, l_linenumber::DOUBLE AS y FROM lineitem),
per AS (
  SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my,
         var_samp(x) * (count(*) - 1) AS xx, var_samp(y) * (count(*) - 1) AS yy,
         covar_samp(x, y) * (count(*) - 1) AS xy FROM rows GROUP BY label),
centre AS (SELECT sum(n * mx) / sum(n) AS gx, sum(n * my) / sum(n) AS gy FROM per),
w AS (
  SELECT sum(xx) AS wxx, sum(xy) AS wxy, sum(yy) AS wyy,
         sum(xx) * sum(yy) - sum(xy) ** 2 AS det,
         sum(n * (mx - gx) ** 2) AS bxx, sum(n * (mx - gx) * (my - gy)) AS bxy,
         sum(n * (my - gy) ** 2) AS byy FROM per, centre)"""


ORACLES["lda_variance"] = f"""
WITH {scatter2("l_returnflag")},
m AS (
  SELECT (wyy * bxx - wxy * bxy) / det AS p, (wyy * bxy - wxy * byy) / det AS q,
         (wxx * bxy - wxy * bxx) / det AS r, (wxx * byy - wxy * bxy) / det AS s FROM w),
eigen AS (
  SELECT unnest([1, 2]) AS component,
         unnest([(p + s) / 2 + sqrt(((p - s) / 2) ** 2 + q * r),
                 (p + s) / 2 - sqrt(((p - s) / 2) ** 2 + q * r)]) AS value FROM m),
shares AS (
  SELECT component, greatest(value, 0) / sum(greatest(value, 0)) OVER () AS share FROM eigen)
SELECT component, round(share, 5) AS explained_variance,
       round(sum(share) OVER (ORDER BY component), 5) AS cumulative_variance FROM shares"""

ORACLES["lda_projection"] = f"""
WITH {scatter2("(l_returnflag <> 'N')::INT")},
gap AS (
  SELECT max(mx) FILTER (label = 1) - max(mx) FILTER (label = 0) AS dx,
         max(my) FILTER (label = 1) - max(my) FILTER (label = 0) AS dy FROM per),
raw AS (SELECT (wyy * dx - wxy * dy) / det AS u, (wxx * dy - wxy * dx) / det AS v FROM w, gap),
unit AS (
  SELECT u / sqrt(u * u + v * v) * sign(CASE WHEN abs(u) >= abs(v) THEN u ELSE v END) AS u,
         v / sqrt(u * u + v * v) * sign(CASE WHEN abs(u) >= abs(v) THEN u ELSE v END) AS v FROM raw)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round((l_quantity - gx) * u + (l_linenumber - gy) * v, 5) AS score
FROM lineitem, centre, unit"""

# --- comparison ----------------------------------------------------------------------------

_MODEL = "dataset, preprocessing, task, k"
_MODELS = f"""{FLOWS},
models(preprocessing, k, cut) AS (
  VALUES ('minimal', NULL::INT, 30.0), ('pca', 1, 10.0), ('pca', 2, 1000.0), ('lda', 1, 40.0)),
scored AS (
  SELECT 'events' AS dataset, preprocessing, task, k, {side("event_id::VARCHAR")} AS split, label,
         value, (value > cut)::INT::DOUBLE AS prediction
  FROM tasks, models WHERE kind = 'binary'),
labels_of AS (SELECT DISTINCT split, {_MODEL}, l.label FROM scored,
  (VALUES (0.0::DOUBLE), (1.0)) l(label)),
{counted("scored", f"split, {_MODEL}", "labels_of")},
results AS (SELECT {summed(f"split, {_MODEL}")} FROM classes GROUP BY split, {_MODEL}),
long AS (
  UNPIVOT (SELECT split, {_MODEL}, accuracy::DOUBLE AS accuracy,
                  weighted_precision::DOUBLE AS weighted_precision,
                  weighted_recall::DOUBLE AS weighted_recall, weighted_f1::DOUBLE AS weighted_f1,
                  attack_fpr::DOUBLE AS attack_fpr FROM results)
  ON accuracy, weighted_precision, weighted_recall, weighted_f1, attack_fpr
  INTO NAME metric VALUE value)"""

_CELLS = f"""{_MODELS},
timed AS (
  SELECT {_MODEL}, median(value) AS s FROM scored WHERE split = 'test' GROUP BY ALL),
reproduced AS (
  SELECT {_MODEL}, metric, value FROM long WHERE split = 'test'
  UNION ALL SELECT {_MODEL}, 'preprocessing_seconds', s FROM timed
  UNION ALL SELECT {_MODEL}, 'cpu_training_seconds', s * 2 FROM timed),
reference AS (
  SELECT {_MODEL}, metric, value AS paper_value, 'fraction' AS unit FROM long WHERE split = 'train'
  UNION ALL
  SELECT {_MODEL}, unnest(['preprocessing_seconds', 'cpu_training_seconds', 'gpu_training_seconds',
    'cpu_testing_seconds', 'cpu_mr_training_seconds']), count(*) / 100.0::DOUBLE, 'seconds'
  FROM scored WHERE split = 'train' GROUP BY {_MODEL}),
joined AS (
  SELECT r.*, CASE WHEN r.metric = 'weighted_f1' AND r.task = 'click' THEN 'excluded'
                   ELSE 'valid' END AS status,
         p.value AS reproduced_value, coalesce(c.collapse_flag, false) AS collapse_flag,
         true AS evaluation_valid
  FROM reference r
  LEFT JOIN reproduced p ON p.dataset = r.dataset AND p.preprocessing = r.preprocessing
    AND p.task = r.task AND p.k IS NOT DISTINCT FROM r.k AND p.metric = r.metric
  LEFT JOIN results c ON c.split = 'test' AND c.dataset = r.dataset AND c.task = r.task
    AND c.preprocessing = r.preprocessing AND c.k IS NOT DISTINCT FROM r.k),
judged AS (
  SELECT *, CASE
      WHEN status = 'excluded' THEN 'excluded-paper-erratum'
      WHEN starts_with(metric, 'gpu_') OR contains(metric, '_mr_') THEN 'unmeasured-backend'
      WHEN reproduced_value IS NULL THEN 'missing-run-result'
      WHEN NOT evaluation_valid THEN 'invalid-run-result'
      WHEN collapse_flag AND unit = 'fraction' THEN 'collapsed-run-result'
      WHEN unit = 'seconds' THEN 'context-only-hardware-mismatch'
      ELSE 'comparable' END AS comparison_status,
    reproduced_value - paper_value AS difference,
    CASE WHEN unit = 'fraction' THEN abs(reproduced_value - paper_value) * 100 END AS pp
  FROM joined),
cells_out AS (
  SELECT *, CASE WHEN metric <> 'accuracy' OR comparison_status <> 'comparable' THEN ''
      WHEN pp <= 1 THEN 'Excellent' WHEN pp <= 3 THEN 'Close' WHEN pp <= 5 THEN 'Directional'
      ELSE 'Divergent' END AS grade FROM judged)"""

ORACLES["comparison_status"] = f"""WITH {_CELLS}
SELECT {_MODEL}, metric, round(paper_value, 6)::DOUBLE AS paper_value, unit, status,
       round(reproduced_value, 6)::DOUBLE AS reproduced_value, collapse_flag, evaluation_valid,
       comparison_status, round(difference, 6)::DOUBLE AS difference,
       round(abs(difference), 6)::DOUBLE AS absolute_difference,
       round(pp, 6)::DOUBLE AS absolute_percentage_points, grade FROM cells_out"""

_ACCURATE = "metric = 'accuracy' AND comparison_status = 'comparable'"
ORACLES["error_summary"] = f"""WITH {_CELLS}
SELECT count(*)::BIGINT AS n, round(median(pp), 6)::DOUBLE AS median_error,
       round(avg(pp), 6)::DOUBLE AS mean_error,
       {", ".join(f"round(avg((pp <= {b})::INT), 6)::DOUBLE AS within_{b}" for b in (1, 3, 5))}
FROM cells_out WHERE {_ACCURATE}"""

ORACLES["error_by_group"] = f"""WITH {_CELLS}
SELECT 'accuracy' AS part, dataset, preprocessing, task, count(*)::BIGINT AS n,
       round(median(pp), 6)::DOUBLE AS median_error, round(avg(pp), 6)::DOUBLE AS mean_error
FROM cells_out WHERE {_ACCURATE} GROUP BY dataset, preprocessing, task"""

ORACLES["chart_published"] = f"""WITH {_CELLS},
shown AS (
  SELECT dataset, task || ' / ' || preprocessing || ' / k=' || coalesce(k::VARCHAR, 'n/a') AS identity,
         collapse_flag, paper_value, reproduced_value
  FROM cells_out
  WHERE metric = 'accuracy' AND comparison_status IN ('comparable', 'collapsed-run-result'))
SELECT dataset, identity, collapse_flag, source, round(accuracy, 6)::DOUBLE AS accuracy
FROM (UNPIVOT shown ON paper_value, reproduced_value INTO NAME source VALUE accuracy)"""

ORACLES["metrics_long"] = f"""WITH {_MODELS}
SELECT {_MODEL}, metric, round(value, 6)::DOUBLE AS value FROM long WHERE split = 'test'"""

ORACLES["best_accuracy"] = f"""WITH {_MODELS},
own AS (SELECT * FROM results WHERE split = 'test'),
best AS (
  SELECT dataset, task, preprocessing, max(accuracy) AS accuracy FROM own WHERE NOT collapse_flag
  GROUP BY ALL),
methods AS (SELECT dataset, count(DISTINCT preprocessing) AS m FROM best GROUP BY 1),
gone AS (SELECT dataset, count(*) FILTER (collapse_flag)::BIGINT AS excluded FROM own GROUP BY 1)
SELECT dataset, task, preprocessing, round(accuracy, 6)::DOUBLE AS accuracy, excluded
FROM best JOIN methods USING (dataset) JOIN gone USING (dataset) WHERE m > 1"""

ORACLES["chart_accuracy_by_k"] = f"""WITH {_MODELS}
SELECT dataset, preprocessing, task, k, round(accuracy, 6)::DOUBLE AS accuracy, collapse_flag
FROM results WHERE split = 'test' AND preprocessing IN ('pca', 'lda') AND k IS NOT NULL"""

ORACLES["collapsed_models"] = f"""WITH {_MODELS}
SELECT dataset, task, preprocessing, coalesce(k::VARCHAR, 'n/a') AS k,
       'zero predictions or recall for supported labels: '
         || string_agg(label::VARCHAR, ', ' ORDER BY label) AS collapse_reason
FROM classes
WHERE split = 'test' AND support > 0 AND (predicted_support = 0 OR recall = 0)
GROUP BY dataset, task, preprocessing, classes.k"""

_VARIANCE = f"""
counted AS (
  SELECT l_returnflag AS dataset, 'pca' AS preprocessing, l_linestatus AS task,
         year(l_shipdate)::INT AS k, l_linenumber AS component, count(*) AS n
  FROM lineitem GROUP BY ALL),
variance AS (
  SELECT {_MODEL}, component, n / sum(n) OVER (PARTITION BY {_MODEL}) AS explained_variance,
         sum(n) OVER (PARTITION BY {_MODEL} ORDER BY component)
           / sum(n) OVER (PARTITION BY {_MODEL}) AS cumulative_variance FROM counted)"""
_ROUNDED_VARIANCE = (
    f"{_MODEL}, component, round(explained_variance, 6)::DOUBLE AS explained_variance,"
    " round(cumulative_variance, 6)::DOUBLE AS cumulative_variance"
)
_LARGEST = "QUALIFY k = max(k) OVER (PARTITION BY dataset, preprocessing, task)"
ORACLES["cumulative_variance"] = f"WITH {_VARIANCE} SELECT {_ROUNDED_VARIANCE} FROM variance"
ORACLES["max_k_rows"] = f"WITH {_VARIANCE} SELECT {_ROUNDED_VARIANCE} FROM variance {_LARGEST}"
ORACLES["variance_long"] = f"""
WITH {_VARIANCE}, largest AS (SELECT * FROM variance {_LARGEST})
SELECT dataset, preprocessing, task, component AS k, metric, round(value, 6)::DOUBLE AS value
FROM (UNPIVOT (SELECT dataset, preprocessing, task, component,
                      explained_variance::DOUBLE AS explained_variance,
                      cumulative_variance::DOUBLE AS cumulative_variance FROM largest)
      ON explained_variance, cumulative_variance INTO NAME metric VALUE value)"""

ORACLES["chart_variance"] = f"""
WITH {_VARIANCE}
SELECT dataset, preprocessing, task, component,
       round(explained_variance, 6)::DOUBLE AS explained_variance,
       round(cumulative_variance, 6)::DOUBLE AS cumulative_variance FROM variance {_LARGEST}"""
_PUBLISHED = (
    _VARIANCE.replace("counted", "some_counted")
    .replace("variance AS (", "published AS (")
    .replace("FROM lineitem GROUP", "FROM lineitem WHERE l_discount <= 0.05 GROUP")
)
ORACLES["variance_errors"] = f"""
WITH {_VARIANCE}, {_PUBLISHED},
found AS (SELECT * FROM variance {_LARGEST}),
wanted AS (SELECT * FROM published {_LARGEST}),
errors AS (
  SELECT dataset, preprocessing,
         unnest([abs(f.explained_variance - w.explained_variance) * 100,
                 abs(f.cumulative_variance - w.cumulative_variance) * 100]) AS error
  FROM wanted w JOIN found f USING (dataset, preprocessing, task, component))
SELECT 'variance' AS part, dataset, preprocessing, NULL::VARCHAR AS task, count(*)::BIGINT AS n,
       round(median(error), 6)::DOUBLE AS median_error, round(avg(error), 6)::DOUBLE AS mean_error
FROM errors GROUP BY dataset, preprocessing"""

_TIMINGS = """
timings AS (
  SELECT l_returnflag AS dataset, l_linestatus AS task, 'm' || (l_linenumber % 3) AS preprocessing,
         CASE WHEN l_linenumber > 1 THEN l_linenumber END AS k,
         l_extendedprice + l_quantity AS preprocessing_seconds, l_quantity AS training_seconds,
         l_discount + l_tax AS evaluation_seconds FROM lineitem)"""
ORACLES["timing_medians"] = f"""
WITH {_TIMINGS},
medians AS (
  SELECT {_MODEL}, median(preprocessing_seconds) AS preprocessing_seconds,
         median(training_seconds) AS cpu_training_seconds,
         median(evaluation_seconds) AS cpu_testing_seconds FROM timings GROUP BY ALL)
SELECT {_MODEL}, metric, round(value, 6)::DOUBLE AS value
FROM (UNPIVOT medians ON preprocessing_seconds, cpu_training_seconds, cpu_testing_seconds
      INTO NAME metric VALUE value)"""

_PHASES = f"""{_TIMINGS},
medians AS (
  SELECT dataset, task, preprocessing, median(preprocessing_seconds) AS preprocessing_seconds,
         median(training_seconds) AS training_seconds,
         median(evaluation_seconds) AS evaluation_seconds FROM timings GROUP BY ALL),
phases AS (
  SELECT * FROM (UNPIVOT medians ON preprocessing_seconds, training_seconds, evaluation_seconds
                 INTO NAME phase VALUE seconds)),
ranks AS (
  SELECT *, rank() OVER (PARTITION BY dataset, task, phase ORDER BY seconds)::INT AS rank
  FROM phases
  QUALIFY len(list(DISTINCT preprocessing) OVER (PARTITION BY dataset, task)) >= 2)"""
ORACLES["timing_ranks"] = f"""
WITH {_PHASES}
SELECT dataset, task, preprocessing, phase, round(seconds, 6)::DOUBLE AS seconds, rank
FROM ranks WHERE phase <> 'evaluation_seconds'"""
ORACLES["ranking_text"] = f"""
WITH {_PHASES}
SELECT dataset, task, phase,
       string_agg(printf('%s (%.3fs)', preprocessing, seconds), ' → ' ORDER BY seconds, preprocessing)
         AS fastest_to_slowest
FROM ranks WHERE phase = 'preprocessing_seconds' GROUP BY ALL"""
ORACLES["chart_phases"] = f"""
WITH {_PHASES}
SELECT dataset, task, preprocessing, phase, round(seconds, 6)::DOUBLE AS seconds FROM phases"""

# --- checks of fits that have no SQL of their own --------------------------------------------

ORACLES["hashed_feature_totals"] = """
SELECT 256::BIGINT AS buckets, 2 * count(*)::BIGINT AS hits, true AS none_negative FROM customer"""
ORACLES["pca_agreement"] = """
SELECT unnest(range(1, 12))::BIGINT AS component, true AS agrees FROM (SELECT count(*) FROM embeddings)"""
ORACLES["lda_beyond_rank"] = """
SELECT 1::BIGINT AS component, 1.0::DOUBLE AS explained_variance,
       round(var_samp(l_quantity), 4) AS variance FROM lineitem
UNION ALL SELECT 2, 0.0, 0.0"""
ORACLES["svm_least_loss"] = """
WITH rows AS (
  SELECT flag, l_linenumber::DOUBLE AS x, CASE WHEN l_returnflag = flag THEN 1 ELSE -1 END AS y, count(*) AS n
  FROM lineitem, (VALUES ('A'), ('N'), ('R')) AS f(flag) GROUP BY ALL),
tried AS (
  SELECT flag, w, y1 - w * x1 AS b FROM (
    SELECT p.flag, p.x AS x1, p.y AS y1, (p.y - q.y) / (p.x - q.x) AS w
    FROM rows p JOIN rows q ON p.flag = q.flag AND p.x < q.x)
  UNION ALL SELECT flag, 0, y FROM rows),
losses AS (
  SELECT flag, w, b, sum(n * greatest(0, 1 - y * (x * w + b))) / sum(n) AS loss
  FROM (SELECT DISTINCT * FROM tried) JOIN rows USING (flag) GROUP BY ALL)
SELECT flag, round(min(loss), 6) AS least, TRUE AS reached FROM losses GROUP BY flag"""

ORACLES["svm_supports"] = f"""
SELECT 'quality' AS task, count(*)::BIGINT AS test_rows FROM documents JOIN labels USING (doc_id)
WHERE {side("doc_id::VARCHAR")} = 'test'
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE {side("vec_id::VARCHAR")} = 'test'"""
ORACLES["svm_separable"] = f"""
SELECT 1.0::DOUBLE AS accuracy, count(*)::BIGINT AS test_rows FROM lineitem
WHERE {side(_LINE_KEY)} = 'test'"""

ORACLES["published_audit"] = f"SELECT *, 'corrected' AS method FROM ({ORACLES['comparison_status']})"
