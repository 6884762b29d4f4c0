"""Job 1: keep a table of minute means, and medians, up to date with a folder of event files that grows.

    python -m jobs.minute_loads SOURCE OUT [--config jobs/minute_loads.json]

SOURCE is a folder of event Parquet files, or a pattern of their names, OUT the folder of the job's tables and checkpoint; both may be remote. Each run
takes the files that no earlier run took, in loads of a configured number of files, and computes again only the days that they touch.
A run without new files changes nothing; one that was broken off is continued by the next. Tables below OUT: `events` (by day and
load), `counts` (by load), `minutes` (by day), and the checkpoint.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.streaming.loads import Loads, follow

log = logging.getLogger("tidewell.jobs.minute_loads")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "minute_loads.json")


def read_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def run(spark: SparkSession, source: str, out: str, config: dict | None = None) -> DataFrame:
    """Take in what is new in source; the minutes of all loads with their variable's median and its number of values.

    Columns are stay_id, minute, variable, value, median and n. Rows without a key, without a value, or with one outside the configured range
    are left out; repeated events of a minute count once. A source without rows gives an empty result.
    """
    config = config or read_config()
    loads = Loads(out)
    columns = {name: F.col(column) for name, column in config["columns"].items()}
    reports = follow(spark, source, loads, f"{out}/checkpoint", columns, X.in_range(F.col("value"), config["low"], config["high"]), config["files_per_load"])
    for r in reports:
        log.info("load %(load)d: read %(read)d rows, kept %(kept)d, wrote %(events)d events and %(minutes)d minutes of %(days)d days", r)
    if not reports:
        log.info("%s has nothing new", source)
    medians = loads.medians(spark)  # a row for each variable; Spark broadcasts it if it is small
    return loads.read(spark, "minutes").join(medians, "variable").select("stay_id", "minute", "variable", "value", "median", "n")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Minute means of event files, load by load.")
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("minute_loads").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        minutes = run(spark, args.source, args.out, read_config(args.config))
        log.info("%s holds %d minutes", args.out, minutes.count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
