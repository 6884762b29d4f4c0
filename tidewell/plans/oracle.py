"""DuckDB SQL of the registered queries, written against the raw tables."""

from __future__ import annotations

from tidewell.operators.metrics import TEST_LEVELS
from tidewell.plans.registry import KEYWORDS, RULES, SEED, TARGETS

_T = ", ".join(f"'{t}'" for t in TARGETS)
_E = """e AS (
  SELECT event_id, user_id AS stay_id, ts AS charttime, event_type AS variable, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid
  FROM events
)"""
_MINUTE = "CAST(floor((epoch_us(charttime) - epoch_us(min(charttime) OVER (PARTITION BY stay_id))) / 60000000.0) AS BIGINT)"
_HOURLY = f"""{_E}, h AS (
  SELECT DISTINCT stay_id, CAST(floor({_MINUTE} / 60.0) AS BIGINT) AS minute, variable, value FROM e
), a AS (
  SELECT stay_id, minute, variable, avg(value) AS value FROM h GROUP BY ALL
)"""
_CANDIDATES = f"""{_HOURLY}, m AS (SELECT stay_id, max(minute) AS max_minute FROM a GROUP BY stay_id), o AS (
  SELECT DISTINCT stay_id, CAST(floor(minute / 10.0) AS BIGINT) - 3 AS k FROM a WHERE variable IN ({_T})
  GROUP BY stay_id, floor(minute / 10.0), variable HAVING count(*) > 1
), c AS (SELECT o.stay_id, o.k FROM o JOIN m USING (stay_id) WHERE k >= 0 AND 10 * k + 40 < max_minute)"""
_FIRST = f"""{_CANDIDATES}, w AS (
  SELECT stay_id, min(k) AS k FROM c
  WHERE EXISTS (SELECT 1 FROM a WHERE a.stay_id = c.stay_id AND a.minute >= 10 * c.k AND a.minute < 10 * c.k + 30) GROUP BY stay_id
)"""
_ROWS = f"""{_FIRST}, s AS (
  SELECT a.stay_id, k, minute - 10 * k AS minute, variable, value, CAST(minute - 10 * k >= 30 AS BIGINT) AS is_target FROM a JOIN w USING (stay_id)
  WHERE minute >= 10 * k AND (minute < 10 * k + 30 OR (minute < 10 * k + 40 AND variable IN ({_T})))
)"""


def _split(source: str) -> str:
    return f"""p AS (
  SELECT subject_id, row_number() OVER (ORDER BY md5('{SEED}:' || subject_id), subject_id) - 1 AS place, count(*) OVER () AS n
  FROM (SELECT DISTINCT {source})
), q AS (
  SELECT subject_id, place, CASE WHEN place < floor(CAST(0.64 AS DOUBLE) * n) THEN 'train' WHEN place < floor(CAST(0.80 AS DOUBLE) * n) THEN 'valid' ELSE 'test' END AS split FROM p
)"""


_STATS = f"""{_ROWS}, {_split("stay_id AS subject_id FROM e")}, f AS (
  SELECT variable, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM s
  WHERE is_target = 0 AND stay_id IN (SELECT subject_id FROM q WHERE split <> 'test') GROUP BY variable
), t AS (
  SELECT v.variable, coalesce(mean, 'NaN'::DOUBLE) AS mean, coalesce(std, 'NaN'::DOUBLE) AS std, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT variable FROM e) v LEFT JOIN f USING (variable)
)"""
_Z = "CASE WHEN isnan(mean) THEN 0.0 ELSE (value - mean) / CASE WHEN std = 0 THEN 1.0 ELSE std END END"
_HISTORY = f"""{_ROWS}, x AS (
  SELECT stay_id, row_number() OVER (PARTITION BY stay_id ORDER BY minute, variable) - 1 AS pos, i.vind, minute, value
  FROM s JOIN (SELECT variable, row_number() OVER (ORDER BY variable) - 1 AS vind FROM (SELECT DISTINCT variable FROM e)) i USING (variable) WHERE is_target = 0
)"""
_CHOSEN = f"""WITH RECURSIVE {_HISTORY}, b AS (
  SELECT *, count(*) OVER (PARTITION BY stay_id) AS n, row_number() OVER (PARTITION BY stay_id, vind ORDER BY pos DESC) AS back FROM x
), r AS (
  SELECT *, CASE vind WHEN 0 THEN back <= 3 WHEN 1 THEN back <= 3 WHEN 4 THEN back <= 3 WHEN 2 THEN back <= 1 ELSE false END AS recent FROM b
), k AS (
  SELECT *, recent AND row_number() OVER (PARTITION BY stay_id, recent ORDER BY pos DESC) <= 12 AS kept FROM r
), u AS (
  SELECT *, row_number() OVER (PARTITION BY stay_id, vind, kept ORDER BY pos) AS place FROM k
), f AS (
  SELECT stay_id, [count(*) FILTER (kept AND vind = 0), count(*) FILTER (kept AND vind = 1), count(*) FILTER (kept AND vind = 4)] AS counts,
    [count(*) FILTER (NOT kept AND vind = 0), count(*) FILTER (NOT kept AND vind = 1), count(*) FILTER (NOT kept AND vind = 4)] AS unused,
    [1, 2, 3] AS still, [0, 0, 0] AS taken, 12 - count(*) FILTER (kept) AS room FROM u GROUP BY stay_id
), turns AS (
  SELECT stay_id, counts, unused, still, taken, room FROM f
  UNION ALL
  SELECT stay_id, list_transform(counts, lambda c, i: c + CASE WHEN has AND i = who THEN 1 ELSE 0 END), list_transform(unused, lambda c, i: c - CASE WHEN has AND i = who THEN 1 ELSE 0 END),
    CASE WHEN has THEN still ELSE list_filter(still, lambda c: c <> who) END, list_transform(taken, lambda c, i: c + CASE WHEN has AND i = who THEN 1 ELSE 0 END),
    room - CASE WHEN has THEN 1 ELSE 0 END
  FROM (SELECT *, still[place] AS who, unused[still[place]] > 0 AS has FROM (
    SELECT *, list_filter(range(1, len(still) + 1), lambda p: p = len(still) OR counts[still[p]] <= counts[still[p + 1]])[1] AS place FROM turns WHERE room > 0 AND len(still) > 0))
), g AS (
  SELECT stay_id, taken FROM turns WHERE room <= 0 OR len(still) = 0
), picked AS (
  SELECT u.*, kept OR coalesce(place <= taken[list_position([0, 1, 4], vind)], false) AS chosen FROM u JOIN g USING (stay_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stay_id, chosen ORDER BY md5('{SEED}:' || stay_id || ':' || pos), pos) AS drawn, 12 - count(*) FILTER (chosen) OVER (PARTITION BY stay_id) AS free FROM picked
), final AS (SELECT * FROM ranked WHERE chosen OR drawn <= free)"""
_DRAWS = """r AS (
  SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS actual, CAST(unnest(embedding) AS DOUBLE) AS draw FROM embeddings
)"""
_SUMMARY = f"""{_DRAWS}, g AS (
  SELECT vec_id, label, actual, quantile_cont(draw, 0.5) AS median, avg(draw) AS mean, quantile_cont(draw, 0.025) AS p025, quantile_cont(draw, 0.975) AS p975
  FROM r GROUP BY ALL
)"""
_SIGNALS = f"""{_SUMMARY}, z AS (
  SELECT label AS signal, count(*) AS n_observations, avg((median - actual) ** 2) AS a, avg((mean - actual) ** 2) AS b,
    avg(((median - actual) * u) ** 2) AS c, avg(((mean - actual) * u) ** 2) AS d
  FROM (SELECT *, CASE WHEN label = 0 THEN 1.0 ELSE label * 0.5 END AS u FROM g) GROUP BY label
), y AS (
  SELECT i.signal, coalesce(n_observations, 0) AS n_observations, round(a, 6) AS mse_median_standardized, round(c, 6) AS mse_median_original,
    round(b, 6) AS mse_mean_standardized, round(d, 6) AS mse_mean_original
  FROM (SELECT range AS signal FROM range(12)) i LEFT JOIN z USING (signal)
)"""
_STEP = "pow(sqrt(0.0001::DOUBLE) + range * ((sqrt(0.5::DOUBLE) - sqrt(0.0001::DOUBLE)) / 49), 2)"
_ALPHA = f"b AS (SELECT range AS step, {_STEP} AS beta FROM range(50)), l AS (SELECT step, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY step)) AS alpha FROM b)"
_CATALOG = ", ".join(f"('{f}', {p}, {lo}, {hi})" for f, p, lo, hi in RULES)
_LABELS = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, p_partkey AS itemid FROM part WHERE " + " OR ".join(f"contains(lower(coalesce(p_name, '')), '{w}')" for w in words) for name, words in KEYWORDS.items()
)

ORACLE = {
    "scan_project": f"WITH {_E} SELECT event_id, stay_id, charttime, value AS valuenum, upper(variable) AS name FROM e",
    "filter_not_both_null": f"""WITH {_E}, n AS (SELECT event_id, nullif(variable, 'error') AS text, CASE WHEN value > 20 THEN value END AS number FROM e)
SELECT * FROM n WHERE text IS NOT NULL OR number IS NOT NULL""",
    "adult_filter_age": """SELECT o_orderkey AS stay_id, o_custkey AS subject_id, CAST(c_custkey % 40 + year(o_orderdate) - 1994 AS BIGINT) AS age
FROM orders JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20 WHERE c_custkey % 40 + year(o_orderdate) - 1994 >= 18""",
    "semi_join_stays": f"WITH {_E} SELECT event_id, stay_id FROM e WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = stay_id AND c_acctbal > 0)",
    "rule_join_drop": f"""WITH {_E}, c(feature, part, low, high) AS (VALUES {_CATALOG})
SELECT event_id, feature, value FROM e JOIN c ON itemid % 8 = part WHERE value BETWEEN low AND high""",
    "unit_convert": f"""WITH {_E}, u AS (SELECT *, CASE variable WHEN 'click' THEN 'mcg' WHEN 'view' THEN 'L' ELSE 'F' END AS old FROM e)
SELECT event_id, round(CASE old WHEN 'mcg' THEN value * 0.001::DOUBLE WHEN 'L' THEN value * 1000 ELSE (value - 32) * 5 / 9 END, 6) AS value,
  CASE old WHEN 'mcg' THEN 'mg' WHEN 'L' THEN 'ml' ELSE old END AS unit, round(CASE WHEN value > 1 THEN value / 100 ELSE value END, 6) AS fraction FROM u""",
    "recode_text": f"""WITH {_E}, n AS (SELECT event_id, nullif(variable, 'view') AS text, value FROM e)
SELECT event_id, CASE text WHEN 'click' THEN 0.0::DOUBLE WHEN 'purchase' THEN 1.0::DOUBLE ELSE value END AS value FROM n WHERE text IS DISTINCT FROM 'error'""",
    "label_keyword_match": _LABELS,
    "binarize": f"WITH {_E} SELECT event_id, CASE WHEN value - 30 > 0 THEN 1.0::DOUBLE ELSE value - 30 END AS flag FROM e",
    "conditional_median_impute": f"""WITH {_E}, m AS (SELECT variable, median(value) FILTER (value BETWEEN 5 AND 60) AS middle FROM e GROUP BY variable)
SELECT event_id, variable, round(CASE WHEN value BETWEEN 5 AND 60 THEN value ELSE middle END, 6) AS value FROM e JOIN m USING (variable)""",
    "hourly_interval_split": f"""WITH {_E}, t AS (
  SELECT event_id, charttime AS a, value AS amount, CAST(floor(value * 60) AS BIGINT) AS sec FROM e
), n AS (SELECT *, CASE WHEN sec > 3600 THEN sec // 3600 ELSE 0 END AS whole FROM t)
SELECT event_id, a + to_hours(CAST(i AS BIGINT)) AS charttime, round(amount * 3600 / sec, 6) AS amount FROM (SELECT *, unnest(range(1, whole + 1)) AS i FROM n WHERE whole > 0)
UNION ALL SELECT event_id, a + to_seconds(sec), round(CASE WHEN whole = 0 THEN amount ELSE amount * (sec - whole * 3600) / sec END, 6) FROM n WHERE whole = 0 OR sec > whole * 3600""",
    "interval_assign_first": """SELECT l_orderkey, l_linenumber, l_partkey AS hadm_id, l_shipdate AS charttime, min(o_orderkey) AS stay_id
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem)
JOIN orders ON o_custkey = l_partkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY ALL""",
    "relative_minute": f"WITH {_E} SELECT event_id, stay_id, {_MINUTE} AS minute FROM e",
    "dedupe_events": f"WITH {_E} SELECT DISTINCT stay_id, variable, CAST(floor(value / 10) AS BIGINT) AS value FROM e",
    "minute_aggregate": f"""WITH {_E}, t AS (SELECT stay_id, {_MINUTE} AS minute, variable, value FROM e), u AS (SELECT DISTINCT * FROM t WHERE value BETWEEN 0 AND 390)
SELECT stay_id, minute, variable, round(avg(value), 6) AS value FROM u GROUP BY ALL""",
    "list_intervals": "SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS stays FROM orders GROUP BY o_custkey",
    "dense_index": f"""WITH {_E}, v AS (SELECT variable, row_number() OVER (ORDER BY variable) - 1 AS vind FROM (SELECT DISTINCT variable FROM e)),
t AS (SELECT stay_id, row_number() OVER (ORDER BY stay_id) - 1 AS ts_ind FROM (SELECT DISTINCT stay_id FROM e))
SELECT event_id, vind, ts_ind, variable IN ({_T}) AS is_target FROM e JOIN v USING (variable) JOIN t USING (stay_id)""",
    "union_sources": f"""WITH {_E} SELECT event_id, value, coalesce(itemid, -1) AS itemid, source FROM (
  SELECT event_id, value, 'chart' AS source FROM e WHERE variable = 'click' UNION ALL BY NAME SELECT event_id, itemid, 'lab' AS source FROM e WHERE variable = 'view')""",
    "static_side_rows": """SELECT c_custkey AS stay_id, 0::BIGINT AS minute, 'Age' AS variable, CAST(c_custkey % 90 AS DOUBLE) AS value FROM customer
UNION ALL SELECT c_custkey, 0, 'Gender', CASE c_nationkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END FROM customer""",
    "stay_max_minute": f"WITH {_HOURLY} SELECT stay_id, max(minute) AS max_minute FROM a GROUP BY stay_id",
    "window_candidates": f"WITH {_CANDIDATES} SELECT stay_id, k FROM c",
    "first_window": f"WITH {_FIRST} SELECT stay_id, k FROM w",
    "window_samples": f"WITH {_ROWS} SELECT stay_id, k, minute, variable, round(value, 6) AS value, is_target FROM s",
    "sample_lengths": f"""WITH {_ROWS} SELECT stay_id, any_value(k) * 10 AS t0, count(*) FILTER (is_target = 0) AS x_len, count(*) FILTER (is_target = 1) AS y_len, count(*) AS n
FROM s GROUP BY stay_id""",
    "patient_split": f"WITH {_split('c_custkey AS subject_id FROM customer')} SELECT subject_id, place, split FROM q",
    "norm_stats": f"WITH {_STATS} SELECT variable, round(mean, 6) AS mean, round(std, 6) AS std, n FROM t",
    "zscore": f"WITH {_STATS} SELECT stay_id, minute, variable, round({_Z}, 6) AS value FROM s JOIN t USING (variable)",
    "unscale_roundtrip": f"WITH {_STATS} SELECT stay_id, minute, variable, round(({_Z}) * CASE WHEN std = 0 THEN 1.0 ELSE std END + mean, 4) AS value FROM s JOIN t USING (variable)",
    "last_n_per_target": f"""WITH {_HISTORY}, k AS (
  SELECT *, row_number() OVER (PARTITION BY stay_id, vind ORDER BY minute DESC, pos DESC) AS place FROM x WHERE vind IN (0, 1, 2, 4)
), j AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY pos DESC) AS back FROM k WHERE place <= CASE vind WHEN 2 THEN 1 ELSE 3 END)
SELECT stay_id, pos, vind, minute, round(value, 6) AS value FROM j WHERE back <= 8""",
    "balanced_triplets": f"""{_CHOSEN}
SELECT stay_id, pos, vind, minute, round(value, 6) AS value,
  row_number() OVER (PARTITION BY stay_id ORDER BY CASE WHEN n > 12 THEN minute END, CASE WHEN n > 12 THEN vind END, pos) - 1 AS slot FROM final""",
    "history_arrays": f"""{_CHOSEN}, y AS (
  SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY minute, vind) - 1 AS slot FROM final
) SELECT i.stay_id, i.slot AS pos, coalesce(CAST(vind AS DOUBLE), 5) AS vind, coalesce(CAST(minute AS DOUBLE), -1) AS minute, round(coalesce(value, 0), 6) AS value,
  CASE WHEN y.slot IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask
FROM (SELECT stay_id, unnest(range(12)) AS slot FROM (SELECT DISTINCT stay_id FROM y)) i LEFT JOIN y USING (stay_id, slot)""",
    "pad_triplets": f"""WITH {_HISTORY} SELECT i.stay_id, i.pos, round(coalesce(value, 0), 6) AS value, coalesce(CAST(minute AS DOUBLE), -1) AS minute,
  CASE WHEN x.pos IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask
FROM (SELECT stay_id, unnest(range(60)) AS pos FROM (SELECT DISTINCT stay_id FROM x)) i LEFT JOIN x USING (stay_id, pos)""",
    "forecast_summary": f"""WITH {_SUMMARY} SELECT vec_id, label, round(actual, 6) AS actual, round(median, 6) AS predicted_median, round(mean, 6) AS predicted_mean,
  round(p025, 6) AS predicted_p025, round(p975, 6) AS predicted_p975 FROM g""",
    "masked_mse": f"""WITH {_SUMMARY} SELECT label, round(avg((mean - actual) ** 2), 6) AS mse, count(*) AS n_observations FROM g WHERE vec_id % 5 <> 0 GROUP BY label""",
    "signal_mse": f"WITH {_SIGNALS} SELECT * FROM y",
    "quantile_crps": f"""WITH {_DRAWS}, g AS (
  SELECT vec_id, label, actual, unnest({TEST_LEVELS}::DOUBLE[]) AS level, unnest(quantile_cont(draw, {TEST_LEVELS})) AS forecast FROM r GROUP BY vec_id, label, actual
), l AS (
  SELECT label, level, 2 * sum(abs((forecast - actual) * (CASE WHEN actual <= forecast THEN 1 ELSE 0 END - level))) / sum(abs(actual)) AS loss FROM g GROUP BY label, level
) SELECT label, round(avg(loss), 6) AS crps FROM l GROUP BY label""",
    "cumprod_schedule": f"""WITH {_ALPHA} SELECT step, round(any_value(beta), 9) AS beta, round(any_value(alpha), 9) AS alpha, count(*) AS n
FROM embeddings JOIN l ON vec_id % 50 = step GROUP BY step""",
    "forward_noise": f"""WITH {_ALPHA} SELECT vec_id, step, round(sqrt(alpha) * CAST(embedding[1] AS DOUBLE) + sqrt(1 - alpha) * CAST(embedding[2] AS DOUBLE), 6) AS noised
FROM embeddings JOIN l ON vec_id % 50 = step""",
    "topk_examples": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "seeded_shuffle": "SELECT c_custkey AS subject_id, row_number() OVER (ORDER BY md5('2026:1:' || c_custkey), c_custkey) - 1 AS place FROM customer",
    "metrics_json_struct": f"WITH {_SIGNALS} SELECT (SELECT count(*) FROM y) AS signals, signal, n_observations, mse_mean_standardized FROM y",
    "empirical_forecast": f"""WITH {_ROWS}, v AS (
  SELECT variable, row_number() OVER (ORDER BY variable) - 1 AS vind FROM (SELECT DISTINCT variable FROM e)
), p AS (
  SELECT s.*, vind, row_number() OVER (PARTITION BY stay_id ORDER BY is_target, minute, variable) - 1 AS pos FROM s JOIN v USING (variable)
), seen AS (
  SELECT stay_id, vind, list(value ORDER BY value) AS held FROM p WHERE is_target = 0 GROUP BY stay_id, vind
), d AS (
  SELECT p.*, [coalesce(held[1 + ('0x' || substr(md5('{SEED}:' || stay_id || ':' || pos || ':' || i), 1, 8))::BIGINT % len(held)], 0) for i in range(1, 21)] AS draws
  FROM p LEFT JOIN seen USING (stay_id, vind) WHERE is_target = 1
)
SELECT stay_id, pos, vind, minute, round(value, 6) AS actual, array_to_string([round(x, 6)::DECIMAL(18, 6)::VARCHAR for x in draws], ',') AS draws FROM d""",
    "rename_columns": "SELECT o_orderkey AS stay_id, o_custkey AS hadm_id, o_totalprice AS amount FROM orders",
    "cast_columns": f"""WITH {_E} SELECT event_id, itemid, itemid / 2.0::DOUBLE AS half, TRY_CAST(variable AS DOUBLE) AS none, charttime AS at FROM e""",
    "drug_rules": f"""WITH {_E}, u AS (
  SELECT event_id, itemid % 5 AS part, CASE WHEN value < 3 THEN 0.0::DOUBLE ELSE value END AS v, CASE variable WHEN 'click' THEN 'mg' WHEN 'error' THEN 'gm' ELSE 'ml' END AS uom FROM e
), c AS (
  SELECT event_id, part, uom, CASE WHEN part IN (1, 2) AND uom = 'mg' THEN v * 0.001::DOUBLE ELSE v END AS v FROM u
), o AS (
  SELECT *, CASE part WHEN 0 THEN v = 0 OR (uom = 'mg' AND v BETWEEN 0 AND 40) WHEN 1 THEN v BETWEEN 0 AND 0.03::DOUBLE
    WHEN 2 THEN v = 0 OR (uom IN ('mg', 'gm') AND v BETWEEN 0 AND 20) WHEN 3 THEN uom = 'gm' AND v BETWEEN 0 AND 30 ELSE v BETWEEN 10 AND 50 END AS ok FROM c
), m AS (SELECT part, median(v) FILTER (ok) AS middle FROM o GROUP BY part)
SELECT event_id, ['Furosemide', 'Vancomycin', 'Calcium Gluconate', 'Heparin', 'Sodium'][part + 1] AS name, round(CASE WHEN ok THEN v ELSE middle END, 6) AS valuenum,
  ['mg', 'g', 'g', 'units', 'mEq/L'][part + 1] AS valueuom FROM o JOIN m USING (part) WHERE ok OR part <> 4""",
    "item_labels": """SELECT itemid, coalesce(nullif(p_name, ''), '') AS label
FROM (SELECT DISTINCT l_partkey AS itemid FROM lineitem WHERE l_quantity IS NOT NULL AND l_partkey IS NOT NULL) LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = itemid""",
    "number_for_text": f"WITH {_E} SELECT event_id, CASE WHEN variable <> 'view' THEN CAST(itemid AS DOUBLE) END AS valuenum, CAST(NULL AS VARCHAR) AS value FROM e",
    "stay_minutes": f"""WITH {_E}, t AS (SELECT *, {_MINUTE} AS minute FROM e)
SELECT event_id, minute, CAST(c_nationkey AS BIGINT) AS hadm_id, stay_id * 10 AS subject_id FROM t JOIN customer ON c_custkey = stay_id""",
    "null_counts": f"""WITH {_E} SELECT count(*) FILTER (variable = 'error') AS variable, count(*) FILTER (NOT value > 20) AS value,
  count(*) FILTER (itemid IS NULL) AS itemid, count(*) AS rows FROM e""",
    "required_rows": f"WITH {_E} SELECT event_id, value FROM e WHERE value BETWEEN 0 AND 390",
    "running_mean": f"WITH {_E} SELECT stay_id, event_id, round(avg(value) OVER (PARTITION BY stay_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM e",
    "noise_loss": """SELECT CAST(label AS BIGINT) AS label, round(sum((CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE)) ** 2) / sum(vec_id % 7), 6) AS loss
FROM embeddings GROUP BY label""",
    "display_labels": f"""WITH {_E} SELECT event_id,
  ['HR (bpm)', 'SBP (mmHg)', 'DBP (mmHg)', 'Temperature (°C)', 'SpO₂ (%)', 'Sodium'][event_id % 6 + 1] AS label FROM e""",
    "prediction_rows": f"""WITH {_SUMMARY}, u AS (SELECT *, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE label * 0.5::DOUBLE END AS f, label * 3.0::DOUBLE AS mu FROM g)
SELECT vec_id AS sample_id, 's' || label AS signal, CAST(vec_id % 10 AS DOUBLE) AS minute, round(actual * f + mu, 6) AS actual, round(median * f + mu, 6) AS predicted_median,
  round(mean * f + mu, 6) AS predicted_mean, round(p025 * f + mu, 6) AS predicted_p025, round(p975 * f + mu, 6) AS predicted_p975 FROM u""",
    "plot_quartiles": f"""WITH {_DRAWS}, g AS (
  SELECT vec_id, label, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS level, unnest(quantile_cont(draw, [0.25, 0.5, 0.75])) AS forecast FROM r GROUP BY vec_id, label
) SELECT label, level, round(avg(forecast), 6) AS forecast FROM g GROUP BY label, level""",
    "row_chunks": "SELECT o_orderkey, ntile(20) OVER (ORDER BY o_orderkey) - 1 AS chunk FROM orders",
    "shuffled_batches": """SELECT subject_id, place // 32 AS batch, place % 32 AS slot
FROM (SELECT c_custkey AS subject_id, row_number() OVER (ORDER BY md5('2026:3:' || c_custkey), c_custkey) - 1 AS place FROM customer)""",
    "target_arrays": f"""WITH {_ROWS}, y AS (
  SELECT stay_id, row_number() OVER (PARTITION BY stay_id ORDER BY minute, variable) - 1 AS pos, i.vind, minute, value
  FROM s JOIN (SELECT variable, row_number() OVER (ORDER BY variable) - 1 AS vind FROM (SELECT DISTINCT variable FROM e)) i USING (variable) WHERE is_target = 1
) SELECT i.stay_id, i.pos, coalesce(CAST(vind AS DOUBLE), 5) AS vind, coalesce(CAST(minute AS DOUBLE), -1) AS minute, round(coalesce(value, 0), 6) AS value,
  CASE WHEN y.pos IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask
FROM (SELECT stay_id, unnest(range(30)) AS pos FROM (SELECT DISTINCT stay_id FROM y)) i LEFT JOIN y USING (stay_id, pos)""",
}
