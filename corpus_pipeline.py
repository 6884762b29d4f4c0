"""The corpus pipeline: language, quality, exact and near duplicates, packing.

Every stage gets what its predecessor kept, as Parquet, and returns the columns of documents; the last returns the packed
pieces. Every stage reads whole texts, however long, ignores columns that it doesn't know, and gives an empty table for an empty one.
A null doc_id is an identifier like any other. Rows with one doc_id share its fate: a stage that decides by doc_id keeps or drops all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, language_id, packing, quality, simhash
from tidewell.llm.shared import table, written

KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = list(KINDS)
LEAST_LANGUAGE_SCORE = 0.4
NEAR_VIEWS = 48
NEAR_SIMILARITY = 0.8


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; one that docs lacks is null."""
    have = set(docs.columns)
    return docs.select(*[F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in KINDS.items()])


def _kept(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in keep; null is an identifier like any other."""
    ids = keep.select(F.col("doc_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose best language gets under LEAST_LANGUAGE_SCORE.

    Null and empty texts have no letters and go. Of languages with equal scores the first by name counts; repeated rows
    stay or go alike. Without a labelled text nothing can be told and all rows go.
    """
    docs = _columns(docs)
    found = language_id.predict(docs, language_id.fit(docs), carry=tuple(COLUMNS))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under the classifier's threshold; a score equal to it stays.

    Null and empty texts are scored as texts without n-grams; repeated rows stay or go alike. Without usable labels every score is
    0.5 and all rows stay.
    """
    docs = _columns(docs)
    scored = quality.with_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")), carry=tuple(COLUMNS))
    return scored.filter(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts; of rows that repeat a doc_id and a text, one.

    Null and empty texts are one group. The longest text stays, then the smallest doc_id, null before all.
    """
    docs = _columns(docs)
    found = written(exact_dedup.exact_dedup(docs), "pipeline-groups")
    kept = _kept(docs, found.filter("kept"))
    if found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return kept
    clean = exact_dedup.normalised(F.col("text"))
    sure = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    kept = kept.withColumn("sha", F.sha2(clean, 256)).join(sure, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_semi")
    longest = Window.partitionBy("doc_id", "sha").orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc())
    return kept.withColumn("place", F.row_number().over(longest)).filter("place = 1").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; a null doc_id stays only in a group without another.

    Candidates are linked fingerprints in any of NEAR_VIEWS views; texts are copies from NEAR_SIMILARITY of five-word shingles on.
    Null and empty texts are copies of each other. Rows that repeat the doc_id that stays all stay.
    """
    docs = _columns(docs)
    return _kept(docs, simhash.without_near_copies(docs, NEAR_SIMILARITY, NEAR_VIEWS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into windows; null and empty texts are their end token, repeated rows each a document."""
    return packing.with_digest(packing.pack(_columns(docs), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
