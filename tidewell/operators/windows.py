"""The first history and target window of each stay, and the samples cut from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY, TARGET, STEP = 30, 10, 10


def last_minute(minutes: DataFrame, stay: str = "stay_id") -> DataFrame:
    return minutes.groupBy(stay).agg(F.max("minute").alias("max_minute"))


def _buckets(minutes: DataFrame, targets: list[str], stay: str, variable: str, repeats: int) -> DataFrame:
    """One row for each stay and bucket of STEP minutes that has a value: k, often, history and max_minute.

    k is the window whose target part the bucket is, often tells that one target variable has `repeats` values in it, history
    that the buckets k to k + 2 hold a value, max_minute is the stay's last minute. One pass over the minutes.
    """
    bucket = F.floor(F.col("minute") / STEP).cast("long").alias("bucket")
    counts = [F.count_if(F.col(variable) == t) for t in targets]
    often = F.greatest(*counts, F.lit(0)) >= repeats if counts else F.lit(False)
    held = minutes.groupBy(stay, bucket).agg(often.alias("often"), F.max("minute").alias("last"))
    reach = HISTORY // STEP
    before = Window.partitionBy(stay).orderBy("bucket").rangeBetween(-reach, -1)
    history = F.count_if(F.col("bucket") >= 0).over(before) > 0
    return held.select(stay, (F.col("bucket") - reach).alias("k"), "often", history.alias("history"), F.max("last").over(Window.partitionBy(stay)).alias("max_minute"))


def window_candidates(minutes: DataFrame, targets: list[str], stay: str = "stay_id", variable: str = "variable", repeats: int = 2) -> DataFrame:
    """stay and k of the windows whose target part holds `repeats` values of one target variable.

    Window k starts at minute STEP * k. Minutes fall into buckets of STEP; the history of window k is the buckets k to k + 2,
    its target bucket k + 3. A window must end before the stay's last minute.
    """
    return _candidates(minutes, targets, stay, variable, repeats).select(stay, "k")


def _candidates(minutes: DataFrame, targets: list[str], stay: str, variable: str, repeats: int) -> DataFrame:
    inside = F.col("k") * STEP + (HISTORY + TARGET) < F.col("max_minute")
    return _buckets(minutes, targets, stay, variable, repeats).filter(F.col("often") & (F.col("k") >= 0) & inside)


def first_windows(minutes: DataFrame, targets: list[str], stay: str = "stay_id", variable: str = "variable") -> DataFrame:
    """stay and k of each stay's first candidate window with a value in its history; one row for a stay at most."""
    return _candidates(minutes, targets, stay, variable, 2).filter("history").groupBy(stay).agg(F.min("k").alias("k"))


def window_rows(minutes: DataFrame, targets: list[str], windows: DataFrame, stay: str = "stay_id", variable: str = "variable", value: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """stay, the columns in carry, k, minute from the window's start, variable, value and is_target of the rows of each stay's window.

    The history has all variables, the target part the target variables.
    """
    return _inside(minutes.join(windows, stay), targets, stay, variable, value, carry)


def first_window_rows(minutes: DataFrame, targets: list[str], stay: str = "stay_id", variable: str = "variable", value: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """window_rows of the first_windows of minutes (one row for each stay, minute and variable), in one pass over them.

    Every window below is served by one order of a stay's rows, so minutes are made, shuffled and sorted once.
    """
    reach, whole = HISTORY // STEP, Window.partitionBy(stay)
    held = minutes.filter(F.col(stay).isNotNull()).withColumn("_bucket", F.floor(F.col("minute") / STEP).cast("long"))
    often = F.col(variable).isin(list(targets)) & (F.count(F.lit(1)).over(Window.partitionBy(stay, "_bucket", variable)) >= 2)
    history = F.count_if(F.col("_bucket") >= 0).over(whole.orderBy("_bucket").rangeBetween(-reach, -1)) > 0
    held = held.withColumns({"_often": often, "_history": history, "_last": F.max("minute").over(whole), "_k": F.col("_bucket") - reach})
    candidate = F.col("_often") & F.col("_history") & (F.col("_k") >= 0) & (F.col("_k") * STEP + (HISTORY + TARGET) < F.col("_last"))
    return _inside(held.withColumn("k", F.min(F.when(candidate, F.col("_k"))).over(whole)), targets, stay, variable, value, carry)


def _inside(rows: DataFrame, targets: list[str], stay: str, variable: str, value: str, carry: tuple[str, ...]) -> DataFrame:
    """The rows (with k) that lie in their stay's window; those without a window go."""
    joined = rows.withColumn("minute", F.col("minute") - F.col("k") * STEP)
    is_target = F.col("minute") >= HISTORY
    kept = joined.filter((F.col("minute") >= 0) & (F.col("minute") < HISTORY + TARGET) & (~is_target | F.col(variable).isin(list(targets))))
    return kept.select(stay, *carry, "k", "minute", variable, value, is_target.cast("int").alias("is_target"))


def samples(rows: DataFrame, stay: str = "stay_id") -> DataFrame:
    """One row for each stay: t0, x_len, y_len and events sorted by part, minute and variable index (vind)."""
    event = F.struct("is_target", "minute", "vind", "value")
    grouped = rows.groupBy(stay).agg(
        (F.first("k") * STEP).alias("t0"), F.sum(1 - F.col("is_target")).cast("int").alias("x_len"), F.sum("is_target").cast("int").alias("y_len"), F.sort_array(F.collect_list(event)).alias("events")
    )
    return grouped
