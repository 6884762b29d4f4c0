"""Scores and summaries of probabilistic forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.operators.joins import small

TEST_LEVELS = [i / 20 for i in range(1, 20)]
VALID_LEVELS = [0.25, 0.5, 0.75]


def long_draws(df: DataFrame, keys: list[str], draws: str = "draws") -> DataFrame:
    """One row for each draw."""
    return df.select(*keys, F.explode(F.col(draws).cast("array<double>")).alias("draw"))


def quantiles(df: DataFrame, keys: list[str], levels: list[float], draw: str = "draw") -> DataFrame:
    """Exact interpolated quantiles of the draws of each key: level and forecast."""
    found = df.groupBy(*keys).agg(F.percentile(F.col(draw), F.array(*map(F.lit, levels))).alias("_q"))
    pairs = F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("_q").alias("forecast"))
    return found.select(*keys, F.inline(pairs).alias("level", "forecast"))


def _sorted(draws: str):
    return F.array_sort(F.filter(F.col(draws).cast("array<double>"), lambda x: x.isNotNull()))


def _at(ordered, level: float):
    """The interpolated quantile of a sorted array; null without elements."""
    place = (F.size(ordered) - 1) * F.lit(level)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return F.when(low == high, a).otherwise((F.lit(1.0) * high - place) * a + (place - low) * b)


def _mean(ordered):
    return F.try_divide(F.aggregate(ordered, F.lit(0.0), lambda t, x: t + x), F.size(ordered))


def array_quantiles(df: DataFrame, keys: list[str], levels: list[float], draws: str = "draws") -> DataFrame:
    """quantiles() of rows that hold their draws as an array: level and forecast, computed in the row, without a shuffle."""
    pairs = F.array(*(F.struct(F.lit(x).alias("level"), _at(F.col("_s"), x).alias("forecast")) for x in levels))
    return df.select(*keys, _sorted(draws).alias("_s")).select(*keys, F.inline(pairs))


def array_means(df: DataFrame, keys: list[str], draws: str = "draws") -> DataFrame:
    """The mean of each row's draws."""
    return df.select(*keys, _mean(_sorted(draws)).alias("mean"))


def array_summary(df: DataFrame, keys: list[str], draws: str = "draws") -> DataFrame:
    """forecast_summary() of rows that hold their draws as an array, without a shuffle."""
    s = F.col("_s")
    return df.select(*keys, _sorted(draws).alias("_s")).select(
        *keys, _at(s, 0.5).alias("predicted_median"), _mean(s).alias("predicted_mean"), _at(s, 0.025).alias("predicted_p025"), _at(s, 0.975).alias("predicted_p975")
    )


def quantile_crps(forecasts: DataFrame, by: list[str], actual: str = "actual", mask: str = "mask") -> DataFrame:
    """Mean over levels of twice the quantile loss, by the sum of absolute actual values; null where that is zero."""
    miss = F.abs((F.col("forecast") - F.col(actual)) * F.col(mask) * (F.when(F.col(actual) <= F.col("forecast"), 1.0).otherwise(0.0) - F.col("level")))
    summed = forecasts.groupBy(*by, "level").agg((F.sum(miss) * 2).alias("loss"), F.sum(F.abs(actual)).alias("size"))
    return summed.groupBy(*by).agg(F.avg(F.try_divide("loss", "size")).alias("crps"))


def masked_mse(df: DataFrame, by: list[str], mean: str = "mean", actual: str = "actual", mask: str = "mask") -> DataFrame:
    """Squared error over masked places; null without any."""
    square = F.pow(F.col(mean) - F.col(actual), 2) * F.col(mask)
    return df.groupBy(*by).agg(F.try_divide(F.sum(square), F.sum(mask)).alias("mse"), F.sum(mask).cast("long").alias("n_observations"))


def forecast_summary(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Median, mean and the 2.5 and 97.5 percent quantiles of the draws of each key."""
    q = F.percentile(F.col("draw"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    found = draws.groupBy(*keys).agg(q.alias("_q"), F.avg("draw").alias("predicted_mean"))
    return found.select(*keys, F.col("_q")[1].alias("predicted_median"), "predicted_mean", F.col("_q")[0].alias("predicted_p025"), F.col("_q")[2].alias("predicted_p975"))


def mse_by_signal(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Squared errors of median and mean, standardized and in clinical units, of every signal; null without rows.

    rows has signal, actual, median, mean and the signal's std; a zero std counts as 1.
    """
    unit = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    scored = rows.groupBy("signal").agg(
        *(F.avg(F.pow((F.col(c) - F.col("actual")) * s, 2)).alias(f"mse_{c}_{name}") for c in ("median", "mean") for name, s in (("standardized", F.lit(1.0)), ("original", unit))),
        F.count(F.lit(1)).alias("n_observations"),
    )
    return signals.select("signal").distinct().join(scored, "signal", "left").fillna(0, ["n_observations"])


def running_mean(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df with running_mean, the mean of a value up to each row."""
    return df.withColumn("running_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def noise_loss(df: DataFrame, by: list[str], residual: str, length: str) -> DataFrame:
    """Squared residuals by the number of target places; null without any."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.pow(F.col(residual), 2)), F.sum(length)).alias("loss"))


def display_unit(name, units: dict[str, str]):
    """A signal's unit as shown; null where it has none."""
    unit = F.lit(None).cast("string")
    for key, text in units.items():
        unit = F.when(name == key, F.lit(text)).otherwise(unit)
    return unit


def display_label(name, names: dict[str, str], units: dict[str, str]):
    """A signal's name as shown, with its unit in brackets where it has one."""
    shown, unit = name, display_unit(name, units)
    for key, text in names.items():
        shown = F.when(name == key, F.lit(text)).otherwise(shown)
    return F.when(unit.isNull(), shown).otherwise(F.concat(shown, F.lit(" ("), unit, F.lit(")")))


def prediction_rows(made: DataFrame, stats: DataFrame, sample: str, signal: str = "signal") -> DataFrame:
    """The forecasts' summary in clinical units: sample_id, signal, minute, actual and the predicted values.

    made has sample, signal, minute, actual and draws in standardized units; stats has signal, mean and std, a zero std counts as 1.
    """
    values = ["actual", "predicted_median", "predicted_mean", "predicted_p025", "predicted_p975"]
    summed = array_summary(made, [sample, signal, "minute", "actual"]).join(small(stats.select(signal, "mean", "std")), signal)
    plain = [X.unscale(F.col(c), F.col("mean"), F.col("std")).alias(c) for c in values]
    return summed.select(F.col(sample).alias("sample_id"), signal, F.col("minute").cast("double").alias("minute"), *plain)
