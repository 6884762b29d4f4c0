"""An epoch's batches as files that several readers share, in an order that seed and epoch decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.numbering import shuffled_batches


def write_epoch(samples: DataFrame, key: str, seed: int, epoch: int, out: str, size: int = 32, readers: int = 1) -> None:
    """Write samples (one row for each key) below out in batches of `size`, dealt in turn to `readers`, and the manifest.

    Batches lie under reader=<n>, in order within and over a reader's files by name; no task holds more than its share of them. The manifest
    has reader, batch and rows. Writing an epoch again gives the same batches.
    """
    ordered = shuffled_batches(samples, key, seed, epoch, size).withColumn("reader", (F.col("batch") % readers).cast("int"))
    ordered = ordered.repartitionByRange("reader", "batch").sortWithinPartitions("reader", "batch", "slot")
    ordered.write.mode("overwrite").partitionBy("reader").parquet(f"{out}/batches")
    written = samples.sparkSession.read.parquet(f"{out}/batches")
    written.groupBy("reader", "batch").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{out}/manifest")


def read_epoch(spark: SparkSession, out: str, reader: int = 0, first: int = 0) -> DataFrame:
    """A reader's rows from batch `first` on; sort by batch and slot where the order matters beyond a file."""
    return spark.read.parquet(f"{out}/batches").filter((F.col("reader") == reader) & (F.col("batch") >= first))


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/manifest")
