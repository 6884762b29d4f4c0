"""Exact de-duplication by a keyed streaming state without expiry.

Every row is reduced to a narrow key row: digest of the normalised text, number of code points, stable
identifier, content locator (file and row position). A stream over these key rows aggregates by digest into
a state store on disk (RocksDB, snapshots in the shared folder); no watermark is set, so a digest is never
forgotten and a later run over the same state folder sees all earlier rows. The state of a digest holds the
best row so far (most code points, then smallest identifier) with its locator, and a count. Spark pre-aggregates
each digest before the shuffle, so a text that a third of all rows share costs one row per task.

A digest that was hit more than once is then checked on full bytes: the texts of its rows are joined with the
text that the locator names, and rows that differ (a digest collision) are grouped again by the text itself.

Only DataFrame operations run on the main path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.shared import BLANKS, shared_path, written

KEY_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("points", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("pos", T.LongType()),
    ]
)
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store reserves megabytes for its log
}


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANKS}+", "")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def stored(df: DataFrame) -> DataFrame:
    """doc_id and text with the file and row position of each row; rows that stem from no file are written to one first."""
    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = {"_file": F.col("_metadata.file_path"), "_pos": F.col("_metadata.row_index")}
    try:
        return narrow.withColumns(place)
    except AnalysisException:  # the hidden column exists for file sources alone
        return written(narrow, "dedup-texts").withColumns(place)


def key_rows(texts: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One narrow row for each row that stored() gives."""
    return texts.withColumn("_clean", normalised(F.col("text"))).select(
        "doc_id",
        digest(F.col("_clean")).alias("digest"),
        F.sha2(F.col("_clean"), 256).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        F.col("_file").alias("file"),
        F.col("_pos").alias("pos"),
    )


def run_state(spark: SparkSession, keys_dir: str, state_dir: str) -> DataFrame:
    """Feed the key rows that state_dir has not seen to the keyed state; return the latest row of each digest.

    state_dir holds the query's checkpoint and the rows that it emitted, by batch. Call it again with the same
    folders after more files were added to keys_dir: the state continues.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(KEY_SCHEMA).parquet(keys_dir)
        best = F.min(F.struct((-F.col("points")).alias("neg_points"), "doc_id", "file", "pos"))
        state = stream.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("hits"))

        def emit(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state_dir}/emitted/batch={batch_id}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_dir}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    emitted = spark.read.option("basePath", f"{state_dir}/emitted").schema(state.schema.add("batch", "long")).parquet(f"{state_dir}/emitted")
    latest = emitted.groupBy("digest").agg(F.max_by(F.struct("best", "hits"), "batch").alias("s"))
    return latest.select("digest", "s.best.*", "s.hits")


def exact_dedup(df: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row for each row of df.

    df needs doc_id (long) and text (string); other columns are ignored. Texts are equal when identical after
    deleting white space; a null text counts as empty, and all empty texts form one group. The row with the most
    code points stays, then the smallest doc_id (a null doc_id sorts first), then the first position; of repeated
    rows with one doc_id only one has kept = true. An empty df gives an empty result.
    """
    spark = df.sparkSession
    keys_dir, state_dir = shared_path(spark, "dedup-keys"), shared_path(spark, "dedup-state")
    df = stored(df)
    key_rows(df, digest).write.parquet(keys_dir)
    keys = spark.read.schema(KEY_SCHEMA).parquet(keys_dir)
    groups = run_state(spark, keys_dir, state_dir).select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"), F.col("pos").alias("keep_pos"), "hits"
    )
    groups = written(groups, "dedup-groups")
    clashing = written(_clashes(df, groups.filter("hits > 1"), digest), "dedup-clashes")
    is_kept = (F.col("file") == F.col("keep_file")) & (F.col("pos") == F.col("keep_pos"))
    joined = keys.join(groups, "digest").select("doc_id", "keep_id", F.col("hits").alias("group_size"), is_kept.alias("kept"), "text_sha256", "digest")
    if clashing.isEmpty():
        return joined.drop("digest")
    sure = joined.join(clashing.select("digest").distinct(), "digest", "left_anti").drop("digest")
    return sure.unionByName(_by_text(df, clashing, digest))


def _texts(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("clean", normalised(F.col("text"))).select("doc_id", F.col("_file").alias("file"), F.col("_pos").alias("pos"), "clean", F.char_length(F.coalesce("text", F.lit(""))).alias("points"), digest(F.col("clean")).alias("digest"))


def _clashes(df: DataFrame, hit: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The digests with a row whose full text differs from the text at the locator."""
    texts = _texts(df, digest).join(hit, "digest").select("digest", "clean", ((F.col("file") == F.col("keep_file")) & (F.col("pos") == F.col("keep_pos"))).alias("here"))
    texts = written(texts, "dedup-hits")
    kept = texts.filter("here").select("digest", F.col("clean").alias("kept_text"))
    return texts.filter("not here").join(kept, "digest").filter(F.col("clean") != F.col("kept_text")).select("digest")


def _by_text(df: DataFrame, clashing: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The result for the rows of clashing digests, grouped by the text itself."""
    rows = _texts(df, digest).join(clashing, "digest", "left_semi")
    best = F.min(F.struct((-F.col("points")).alias("neg_points"), "doc_id", "file", "pos"))
    groups = rows.groupBy("clean").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    kept = (F.col("file") == F.col("best.file")) & (F.col("pos") == F.col("best.pos"))
    return rows.join(groups, "clean").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.sha2("clean", 256).alias("text_sha256"))
