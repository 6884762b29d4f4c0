"""Minute means and medians over events that arrive in loads: a load's rows are read once, and only what they touch is computed again.

Three tables grow below one folder. `events` has the distinct events of each load and how often they came, by day; `counts` the occurrences of each valid
value, by load, from which medians of all loads follow without their rows; `minutes` the means, by day, computed again for the
days of a load. A load is written under its number, so a load that is run again replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.operators import align
from tidewell.sources.stages import observed, seen, write_stage

EVENT = "stay_id long, minute timestamp_ntz, variable string, value double, n long, day date, load long"
COUNT = "variable string, value double, n long, load long"
MINUTE = "stay_id long, minute timestamp_ntz, variable string, value double, day date"


@dataclass(frozen=True)
class Loads:
    """The tables below a folder."""

    folder: str

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """One of the tables; empty before the first load that wrote it."""
        schema = {"events": EVENT, "counts": COUNT, "minutes": MINUTE}[name]
        path = f"{self.folder}/{name}"
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return spark.createDataFrame([], schema)
            raise

    def add(self, events: DataFrame, load: int, valid: Column | None = None) -> dict[str, int]:
        """Take a load (stay_id, charttime, variable, value) in; the rows read, kept and written.

        Rows without a stay, time or variable and those that aren't valid, or have no value, are left out; the clock minute of an event
        stands for it. Running a load again gives the same tables.
        """
        spark = events.sparkSession
        ok = F.coalesce(valid if valid is not None else F.lit(True), F.lit(False)) & ~X.missing(F.col("value"))
        keyed = F.col("stay_id").isNotNull() & F.col("charttime").isNotNull() & F.col("variable").isNotNull()
        minute = F.date_trunc("minute", F.col("charttime")).cast("timestamp_ntz").alias("minute")
        named = events.select(F.col("stay_id").cast("long").alias("stay_id"), minute, "variable", F.col("value").cast("double").alias("value"), (ok & keyed).alias("kept"))
        named, watch = observed(named, {"kept": F.col("kept")})
        distinct = named.filter("kept").groupBy("stay_id", "minute", "variable", "value").agg(F.count(F.lit(1)).alias("n"))
        distinct = distinct.withColumns({"day": F.to_date("minute"), "load": F.lit(load).cast("long")})
        wrote = write_stage(distinct, f"{self.folder}/events", partition=("day", "load"), dynamic=True)
        took = seen(watch)
        own = self.read(spark, "events").filter(F.col("load") == load)
        write_stage(own.groupBy("variable", "value", "load").agg(F.sum("n").alias("n")), f"{self.folder}/counts", partition=("load",), dynamic=True)
        days = sorted(r["day"] for r in own.select("day").distinct().collect())  # the calendar days of a load
        return {"read": took.get("rows", 0), "kept": took.get("kept", 0), "events": wrote["rows"], "days": len(days), "minutes": self.refresh(spark, days)}

    def refresh(self, spark: SparkSession, days: list) -> int:
        """Compute the minute means of these days from all loads; other days are neither read nor written."""
        if not days:
            return 0
        events = self.read(spark, "events").filter(F.col("day").isin(days))
        distinct = align.distinct_events(events, "stay_id", "minute", "variable", "value", "day")
        means = align.minute_means(distinct, firsts=("day",))
        return write_stage(means, f"{self.folder}/minutes", partition=("day",), dynamic=True)["rows"]

    def medians(self, spark: SparkSession) -> DataFrame:
        """variable, n and the exact interpolated median of the valid values of all loads, from their counts."""
        counted = self.read(spark, "counts").groupBy("variable", "value").agg(F.sum("n").alias("n"))
        return counted.groupBy("variable").agg(F.sum("n").alias("n"), F.percentile(F.col("value"), F.lit(0.5), F.col("n")).alias("median"))


def follow(spark: SparkSession, source: str, loads: Loads, checkpoint: str, columns: dict[str, Column], valid: Column | None = None, files: int = 1, fmt: str = "parquet", schema=None) -> list[dict[str, int]]:
    """Take in the files of source that no earlier call with this checkpoint took, `files` a load, and return each load's counts.

    columns gives stay_id, charttime, variable and value. The stream's checkpoint holds which files are done; a load that was
    broken off comes again under its number, with the same files.
    """
    schema = schema or spark.read.format(fmt).load(source).schema
    reports: list[dict[str, int]] = []

    def one(batch: DataFrame, number: int) -> None:
        reports.append({"load": number, **loads.add(batch.select(*[c.alias(n) for n, c in columns.items()]), number, valid)})

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return reports
