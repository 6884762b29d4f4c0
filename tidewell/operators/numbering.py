"""Dense ranks without one task that sees all rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def hash_rank(df: DataFrame, digest: Column, tie: str) -> DataFrame:
    """df with place, its rank from 0 by a hexadecimal digest, then by tie, and n, the number of rows.

    The digest's first digits make 4096 buckets that tasks rank separately; only the buckets' sizes are summed in one place.
    """
    keyed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("n"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", tie))
    ranked = keyed.withColumn("_own", own).join(F.broadcast(offsets), "_bucket")  # 4096 rows at most
    return ranked.withColumn("place", F.col("_before") + F.col("_own") - 1).drop("_digest", "_bucket", "_own", "_before")


def ordered_rank(df: DataFrame, key: str, *ties: str, buckets: int = 4096) -> DataFrame:
    """df with place, its rank from 0 by a whole-number key, then by ties; a null key comes first.

    The keys' quantiles cut their range into buckets of about as many rows, whatever their distances, which tasks rank
    separately; only the buckets' sizes are summed in one place. Rows of one key and equal ties are numbered in any order.
    """
    levels = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    found = df.agg(F.percentile_approx(key, levels, 4 * buckets).alias("q")).first()["q"] or []
    bounds = [float("-inf"), *sorted({float(x) for x in found}), float("inf")]
    number = F.col(key).cast("double").alias("_number")
    keyed = Bucketizer(splits=bounds, inputCol="_number", outputCol="_bucket", handleInvalid="keep").transform(df.select("*", number)) if len(bounds) > 2 else df.select("*", number, F.lit(0.0).alias("_bucket"))
    keyed = keyed.withColumn("_bucket", F.when(F.col("_number").isNull(), F.lit(-1)).otherwise(F.col("_bucket").cast("int"))).drop("_number")
    return _ranked(keyed, "_bucket", [key, *ties], "place").drop("_bucket")


def _ranked(df: DataFrame, bucket: str, order: list, place: str) -> DataFrame:
    """df with its rank from 0 by bucket, then by order, from the buckets' sizes."""
    counts = sorted((r[bucket], r["n"]) for r in df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for value, n in counts:
        offsets.append((value, total))
        total += n
    kind = df.schema[bucket].dataType.simpleString()
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, f"{bucket} {kind}, _before long"))  # a row for each bucket
    own = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_own", own).join(before, bucket).withColumn(place, F.col("_before") + F.col("_own") - 1).drop("_own", "_before")


def file_places(df: DataFrame, name: str = "place") -> DataFrame:
    """df, as read from files, with each row's place from 0 in the order of the files' names and of the rows in them.

    A file's blocks are read by one task each, so a row's place in its block is the order in which the task met it; the blocks' sizes
    give the rest. Take it straight from a reader: _metadata must be there, and no row filtered before if places shall be those in the files.
    """
    read = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_met"))
    marked = read.withColumn("_block", F.struct("_file", "_start"))
    sizes = marked.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block of a file
    offsets = sizes.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("_met"))
    placed = marked.withColumn("_own", own).join(offsets, "_block")
    return placed.withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_file", "_start", "_met", "_block", "_own", "_before")


def row_chunks(df: DataFrame, key: str, *ties: str, chunks: int = 20) -> DataFrame:
    """df with chunk, from 0: near-equal blocks of rows in the order of a whole-number key; the first ones have one row more."""
    ranked = ordered_rank(df, key, *ties)
    size, more = divmod(df.count(), chunks)
    place, long = F.col("place"), more * (size + 1)
    later = F.lit(more) + F.floor((place - long) / max(1, size))
    return ranked.withColumn("chunk", F.when(place < long, F.floor(place / (size + 1))).otherwise(later).cast("long")).drop("place")


def shuffled_batches(df: DataFrame, key: str, seed: int, epoch: int, size: int = 32) -> DataFrame:
    """df with batch and slot: batches of `size` rows in an order that seed and epoch decide."""
    ranked = hash_rank(df, F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string"))), key)
    return ranked.withColumns({"batch": F.floor(F.col("place") / size).cast("long"), "slot": (F.col("place") % size).cast("long")}).drop("place", "n")
