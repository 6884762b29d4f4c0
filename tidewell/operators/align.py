"""Clean features to one value for each stay, minute and variable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.operators.joins import dealt
from tidewell.operators.numbering import ordered_rank


def assign_stay(events: DataFrame, stays: DataFrame, key: str = "hadm_id", at: str = "charttime", order: str = "stay_ord") -> DataFrame:
    """Events of an admission with the first stay, by `order`, whose closed interval holds their time; others go.

    stays has key, stay_id, intime, outtime and order. An admission's few stays travel as one array, so events are
    neither multiplied nor shuffled for the choice.
    """
    one = F.struct(order, "stay_id", "intime", "outtime")
    by_key = stays.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("_stays"))
    joined = events.drop("stay_id").join(by_key, key)
    inside = F.filter("_stays", lambda s: (F.col(at) >= s["intime"]) & (F.col(at) <= s["outtime"]))
    return joined.withColumn("stay_id", F.get(inside, F.lit(0))["stay_id"]).drop("_stays").filter(F.col("stay_id").isNotNull())


def with_minutes(events: DataFrame, stays: DataFrame, stay: str = "stay_id", at: str = "charttime") -> DataFrame:
    """Events with the whole minutes since their stay began."""
    starts = stays.select(stay, F.col("intime").alias("_intime"))
    return events.join(starts, stay).withColumn("minute", X.relative_minute(F.col("_intime"), F.col(at))).drop("_intime")


def minutes_since_first(events: DataFrame, stay: str, at: str) -> DataFrame:
    """Events with the whole minutes since the stay's first event."""
    first = events.groupBy(stay).agg(F.min(at).alias("_first"))
    return events.join(first, stay).withColumn("minute", X.relative_minute(F.col("_first"), F.col(at))).drop("_first")


def dealt_minutes(events: DataFrame, stay: str, at: str) -> DataFrame:
    """minutes_since_first of events that are dealt by stay once; what follows by stay needs no other shuffle."""
    first = F.min(at).over(Window.partitionBy(stay))
    return dealt(events.filter(F.col(stay).isNotNull()), stay).withColumn("minute", X.relative_minute(first, F.col(at)))


def distinct_events(events: DataFrame, *columns: str) -> DataFrame:
    """One row for each combination of the columns; nulls are equal to each other."""
    return events.select(*columns).dropDuplicates()


def minute_means(events: DataFrame, stay: str = "stay_id", variable: str = "variable", value: str = "value", firsts: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the present values for each stay, minute and variable; NaN where all are missing; null keys go."""
    keyed = events.filter(F.col(stay).isNotNull() & F.col("minute").isNotNull() & F.col(variable).isNotNull())
    clean = F.when(F.isnan(value), F.lit(None)).otherwise(F.col(value))
    mean = F.coalesce(F.avg(clean), F.lit(float("nan"))).alias(value)
    return keyed.groupBy(stay, "minute", variable).agg(mean, *(F.first(c, ignorenulls=True).alias(c) for c in firsts))


def variable_index(names: DataFrame, targets: list[str], interventions: list[str] = ()) -> DataFrame:
    """vind, name, is_target and is_intervention of the distinct names, in the order of their bytes.

    Raises when a target is absent. The names are a small dimension; one task numbers them.
    """
    distinct = names.select("name").filter("name is not null").distinct()
    have = {r["name"] for r in distinct.filter(F.col("name").isin(list(targets))).collect()}
    if lost := [t for t in targets if t not in have]:
        raise ValueError(f"no events of {', '.join(lost)}")
    vind = (F.row_number().over(Window.orderBy("name")) - 1).alias("vind")
    return distinct.select(vind, "name", F.col("name").isin(list(targets)).alias("is_target"), F.col("name").isin(list(interventions)).alias("is_intervention"))


def stay_index(stays: DataFrame, order: str = "stay_ord") -> DataFrame:
    """ts_ind: the stays' positions from 0 in their order, a whole number; no task sees all stays."""
    return ordered_rank(stays, order).withColumnRenamed("place", "ts_ind")


def statics(stays: DataFrame) -> DataFrame:
    """Age and gender as events at minute 0; gender is 0 for M, 1 for F."""
    gender = F.when(F.col("gender") == "M", 0.0).when(F.col("gender") == "F", 1.0)
    melted = F.inline(F.array(F.struct(F.lit("Age").alias("variable"), F.col("age").cast("double").alias("value")), F.struct(F.lit("Gender").alias("variable"), gender.alias("value"))))
    return stays.select("stay_id", F.lit(0).cast("long").alias("minute"), melted)
