"""Join sides of a checked size, rows dealt once for the steps that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 50_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than `most` rows; else as it is, for Spark to shuffle.

    Its plan runs once: the rows that were counted are the table that is broadcast. A table beyond the bound runs again.
    """
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over spark.sql.shuffle.partitions tasks.

    Adaptive execution merges small shuffles into tasks of its advised compressed size, which steps with many sorts and sums in one
    stage hold several times. It leaves a named number of partitions alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
