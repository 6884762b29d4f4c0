"""The jobs as queries over the driver's tables, and their DuckDB SQL.

Each query runs its job twice into one new folder, so that the second run finds nothing new or replaces the first, and returns what the
folder then holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import minute_loads, note_features
from tidewell.sources.scratch import new_path


def job1_minute_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute means and medians of all events."""
    out = new_path(spark, "minute-loads")
    for _ in range(2):
        made = minute_loads.run(spark, f"{sf_dir}/event[s].parquet", out)  # a pattern, since a stream takes no plain file
    return made.withColumns({c: F.round(c, 6) for c in ("value", "median")})


def job2_note_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all documents and conversation turns."""
    out = new_path(spark, "note-features")
    for _ in range(2):
        made = note_features.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", out)
    return made


QUERIES = {"job1_minute_loads": job1_minute_loads, "job2_note_features": job2_note_features}

_WORDS = note_features.read_config()["keywords"]
_FLAGS = ", ".join("(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f")::INT::DOUBLE AS {name}" for name, words in sorted(_WORDS.items()))
_NAMES = [*sorted(_WORDS), "words", "numbers", "characters"]
_RANGE = minute_loads.read_config()

ORACLE = {
    "job1_minute_loads": f"""WITH e AS (
  SELECT user_id AS stay_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, event_type AS variable, value FROM events
  WHERE value BETWEEN {_RANGE['low']} AND {_RANGE['high']} AND user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL
), m AS (SELECT variable, median(value) AS median, count(*) AS n FROM e GROUP BY variable), u AS (SELECT DISTINCT * FROM e)
SELECT stay_id, minute, variable, round(avg(value), 6) AS value, round(any_value(median), 6) AS median, any_value(n) AS n FROM u JOIN m USING (variable) GROUP BY stay_id, minute, variable""",
    "job2_note_features": f"""WITH t AS (
  SELECT 'document' AS kind, doc_id AS note_id, 0::BIGINT AS part, 's:' || source AS subject_id, lang, text FROM documents
  UNION ALL SELECT 'conversation', conv_id, CAST(turn AS BIGINT), 'c:' || conv_id, NULL, text FROM conversations
), d AS (
  SELECT kind, subject_id, lang, text, min((note_id, part)) AS note FROM t WHERE text IS NOT NULL AND subject_id IS NOT NULL GROUP BY ALL
), f AS (
  SELECT kind, subject_id, lang, note, {_FLAGS}, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::DOUBLE AS words,
    len(regexp_extract_all(text, '[0-9]+'))::DOUBLE AS numbers, length(text)::DOUBLE AS characters FROM d
), r AS (
  UNPIVOT f ON {", ".join(_NAMES)} INTO NAME variable VALUE value
), p AS (
  SELECT subject_id, row_number() OVER (ORDER BY md5('2026:' || subject_id), subject_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM r)
), q AS (
  SELECT subject_id, CASE WHEN place < floor(CAST(0.64 AS DOUBLE) * n) THEN 'train' WHEN place < floor(CAST(0.80 AS DOUBLE) * n) THEN 'valid' ELSE 'test' END AS split FROM p
), s AS (
  SELECT variable, avg(value) AS mean, stddev_pop(value) AS std FROM r JOIN q USING (subject_id) WHERE split = 'train' GROUP BY variable
)
SELECT note[1] AS note_id, note[2] AS part, subject_id, lang, variable, value,
  round(CASE WHEN mean IS NULL THEN 0.0::DOUBLE ELSE (value - mean) / CASE WHEN std = 0 THEN 1.0::DOUBLE ELSE std END END, 6) AS score, split, kind
FROM r JOIN q USING (subject_id) LEFT JOIN s USING (variable)""",
}
