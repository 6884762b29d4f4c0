"""Statistics of the training history and standard scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.operators.joins import small


def fit_stats(rows: DataFrame, variables: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """variable, mean, std (of the population) and n of every variable; NaN in, NaN out; NaN without rows."""
    nan = F.lit(float("nan"))
    found = rows.groupBy(variable).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))
    joined = variables.select(variable).distinct().join(found, variable, "left")
    return joined.select(variable, F.coalesce("mean", nan).alias("mean"), F.coalesce("std", nan).alias("std"), F.coalesce("n", F.lit(0)).alias("n"))


def with_stats(rows: DataFrame, stats: DataFrame, variable: str) -> DataFrame:
    """Rows with their variable's mean and std; the statistics go to the rows, which stay where they are."""
    return rows.join(small(stats.select(variable, "mean", "std")), variable, "left")


def scale(rows: DataFrame, stats: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    joined = with_stats(rows, stats, variable)
    return joined.withColumn(value, X.zscore(F.col(value), F.col("mean"), F.col("std"))).drop("mean", "std")


def unscale(rows: DataFrame, stats: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    joined = with_stats(rows, stats, variable)
    return joined.withColumn(value, X.unscale(F.col(value), F.col("mean"), F.col("std"))).drop("mean", "std")
