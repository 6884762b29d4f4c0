"""Forecasters: the interface, a seeded empirical baseline, and the schedule and sampler of a diffusion model.

A forecaster turns samples into draws. Neural networks stay outside; the sampler takes any denoiser as a function.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.shipping import ship


class Forecaster(Protocol):
    def forecast(self, rows: DataFrame, draws: int) -> DataFrame:
        """rows (sample, pos, vind, minute, is_target, value) to (sample, pos, vind, minute, actual, draws)."""
        ...


class EmpiricalForecaster:
    """Draws from the sample's own history of a variable, with replacement; zeros without history."""

    def __init__(self, seed: int = 0, sample: str = "stay_id"):
        self.seed, self.sample = seed, sample

    def forecast(self, rows: DataFrame, draws: int) -> DataFrame:
        if draws < 1:
            raise ValueError("at least one draw is needed")
        s = self.sample
        past = F.when((F.col("is_target") == 0) & F.col(s).isNotNull() & F.col("vind").isNotNull(), F.col("value"))
        seen = F.collect_list(past).over(Window.partitionBy(s, "vind"))  # rows are made once, and a sample's history is short
        wanted = rows.withColumn("_seen", seen).filter("is_target = 1").withColumn("_seen", F.sort_array("_seen"))
        joined = wanted.withColumnRenamed("value", "actual")
        digest = lambda i: F.md5(F.concat_ws(":", F.lit(self.seed), F.col(s).cast("string"), F.col("pos").cast("string"), i.cast("string")))
        number = lambda i: F.conv(F.substring(digest(i), 1, 8), 16, 10).cast("long")
        pick = lambda i: F.get("_seen", (number(i) % F.size("_seen")).cast("int"))
        drawn = F.when(F.size("_seen") > 0, F.transform(F.sequence(F.lit(1), F.lit(draws)), pick)).otherwise(F.array_repeat(F.lit(0.0), draws))
        return joined.select(s, "pos", "vind", "minute", "actual", drawn.alias("draws"))


def schedule(steps: int = 50, first: float = 0.0001, last: float = 0.5) -> np.ndarray:
    """beta of each step: squares of evenly spaced roots."""
    return np.linspace(first**0.5, last**0.5, steps) ** 2


def schedule_table(spark: SparkSession, steps: int = 50, first: float = 0.0001, last: float = 0.5) -> DataFrame:
    """step, beta and alpha (the running product of 1 - beta), made in Spark."""
    a, b = first**0.5, last**0.5
    beta = F.pow(F.lit(a) + F.col("step") * F.lit((b - a) / max(1, steps - 1)), F.lit(2.0))
    rows = spark.range(steps).select(F.col("id").cast("int").alias("step")).withColumn("beta", beta)
    gathered = rows.agg(F.sort_array(F.collect_list(F.struct("step", "beta"))).alias("all"))  # `steps` rows
    product = lambda i: F.aggregate(F.slice("all", F.lit(1), i), F.lit(1.0), lambda acc, x: acc * (1 - x["beta"]))
    each = gathered.select(F.posexplode("all").alias("i", "x"), "all")
    return each.select(F.col("x.step").alias("step"), F.col("x.beta").alias("beta"), product(F.col("i") + 1).alias("alpha"))


def noised(value, noise, alpha, mask):
    """The forward step: a value at noise level alpha; masked places are zero."""
    return (F.sqrt(alpha) * value + F.sqrt(1 - alpha) * noise) * mask


def reverse_draws(start: np.ndarray, denoise: Callable[[np.ndarray, int], np.ndarray], rng: np.random.Generator, beta: np.ndarray) -> np.ndarray:
    """Ancestral sampling from noise: denoise(x, step) predicts the noise in x."""
    keep = 1 - beta
    alpha = np.cumprod(keep)
    x = start
    for t in range(len(beta) - 1, -1, -1):
        x = (x - beta[t] / np.sqrt(1 - alpha[t]) * denoise(x, t)) / np.sqrt(keep[t])
        if t:
            x = x + np.sqrt((1 - alpha[t - 1]) / (1 - alpha[t]) * beta[t]) * rng.standard_normal(x.shape)
    return x


class DiffusionForecaster:
    """Draws by reverse diffusion with a given denoiser (x, step, rows of the sample) over Arrow batches.

    beta is the schedule that the denoiser was trained with, that of schedule(steps) if none is given.
    """

    def __init__(self, denoise: Callable, seed: int = 0, steps: int = 50, sample: str = "stay_id", beta: np.ndarray | None = None):
        self.denoise, self.seed, self.sample = denoise, seed, sample
        self.beta = schedule(steps) if beta is None else np.asarray(beta, float)

    def forecast(self, rows: DataFrame, draws: int) -> DataFrame:
        denoise, seed, beta, s = self.denoise, self.seed, self.beta, self.sample

        def run(group: pd.DataFrame) -> pd.DataFrame:
            wanted = group[group["is_target"] == 1].sort_values("pos")
            rng = np.random.default_rng([seed, int(group[s].iloc[0]) & 0x7FFFFFFF])
            x = reverse_draws(rng.standard_normal((draws, len(wanted))), lambda v, t: denoise(v, t, group), rng, beta)
            return pd.DataFrame({s: wanted[s], "pos": wanted["pos"], "vind": wanted["vind"], "minute": wanted["minute"], "actual": wanted["value"], "draws": list(x.T)})

        ship(rows.sparkSession)
        return rows.groupBy(s).applyInPandas(run, f"{s} long, pos int, vind int, minute long, actual double, draws array<double>")
