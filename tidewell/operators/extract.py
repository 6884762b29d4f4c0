"""Raw events to clean features: filters, conversions, rule join, conditional medians, hourly splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import catalog, expressions as X
from tidewell.operators.joins import small


def rename_all(df: DataFrame, rename: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[rename(c) for c in df.columns])


def engine_name(column: str) -> str:
    """Lower-cased names; the stay identifier of older exports has its present name."""
    return {"icustay_id": "stay_id"}.get(column.lower(), column.lower())


def with_values(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns have a value."""
    return df.dropna(how="any", subset=list(columns))


def not_both_null(df: DataFrame, text: str, number: str) -> DataFrame:
    return df.filter(F.col(text).isNotNull() | F.col(number).isNotNull())


def adults(stays: DataFrame, patients: DataFrame, least: int = 18) -> DataFrame:
    """Stays with the patient's age at admission, from `least` years; stays of unknown age go."""
    known = stays.join(patients, "subject_id", "left")
    return known.withColumn("age", X.age_at(F.col("anchor_age"), F.col("anchor_year"), F.col("intime"))).filter(F.col("age") >= least)


def of_keys(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is in keys."""
    return df.join(keys.select(*on), list(on), "left_semi")


def split_hourly(df: DataFrame, start: str = "starttime", end: str = "endtime", amount: str = "amount", at: str = "charttime") -> DataFrame:
    """Intervals over an hour as hourly shares of their amount, the rest at the end; others as one row at the end.

    Rows without a start or an end go. An interval that ends before it starts is one row at its end. The total amount of
    an interval stays the same.
    """
    micros = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))
    hour = 3_600_000_000
    timed = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_us", micros)
    whole = F.when(F.col("_us") > hour, F.floor(F.col("_us") / hour)).otherwise(F.lit(0))
    marked = timed.withColumn("_n", whole.cast("int"))
    rest = (F.col("_us") - F.col("_n") * F.lit(hour)).cast("long")
    steps = F.when(F.col("_n") == 0, F.array(F.lit(0))).otherwise(
        F.concat(F.sequence(F.lit(1), F.col("_n")), F.when(rest > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    )
    each = marked.withColumn("_i", F.explode(steps))
    share = F.when(F.col("_n") == 0, F.col(amount)).when(F.col("_i") > 0, F.col(amount) * hour / F.col("_us")).otherwise(F.col(amount) * rest / F.col("_us"))
    place = F.when(F.col("_i") > 0, F.timestamp_add("HOUR", F.col("_i"), F.col(start))).otherwise(F.col(end))
    return each.withColumn(at, place).withColumn("_share", share).drop("_us", "_n", "_i", amount, start, end).withColumnRenamed("_share", amount)


def medians(df: DataFrame, group: str, value: str, ok: Column) -> DataFrame:
    """Exact interpolated median of the valid values of each group, from counts of equal values."""
    valid = df.filter(F.coalesce(ok, F.lit(False)) & ~X.missing(F.col(value)))
    counted = valid.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(group).agg(F.percentile(F.col(value), F.lit(0.5), F.col("_n")).alias("median"))


def impute_median(df: DataFrame, group: str, value: str, ok: Column) -> DataFrame:
    """Values that are not valid become their group's median, null where a group has no valid value."""
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False)) & ~X.missing(F.col(value)))
    filled = marked.join(small(medians(marked, group, value, F.col("_ok"))), group, "left")
    return filled.withColumn(value, F.when(F.col("_ok"), F.col(value)).otherwise(F.col("median"))).drop("_ok", "median")


def label_items(items: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """feature and itemid of the items whose label holds a keyword; an item can have several features."""
    found = F.array(*(F.when(X.contains_any(F.col("label"), words), F.lit(name)) for name, words in keywords.items()))
    return items.select(F.explode(F.array_compact(found)).alias("feature"), "itemid").distinct()


def apply_rules(events: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """Events (itemid, source, value, valuenum, valueuom, ...) as clean features with the column name.

    One join gives every event the features that its item feeds; each feature's rule then converts, tests and drops,
    imputes or keeps. items has feature, itemid, factor and offset; rules is catalog.rule_table's. Both are dimensions; mark
    them with joins.small() to keep events from being shuffled.
    """
    joined = events.join(items, "itemid").join(rules, ["feature", "source"])
    for name, text in catalog.DROPPED_TEXT.items():
        joined = joined.filter(~((F.col("feature") == name) & F.col("value").eqNullSafe(text)))
    number = F.col("valuenum") * F.col("factor") + F.col("offset")
    number = F.when(F.col("percent"), X.fraction(number)).otherwise(number)
    number = F.when(F.col("to_grams") & (F.col("valueuom") == "mg"), number * 0.001).otherwise(number)
    number = F.when(F.col("binary"), X.binary(number)).otherwise(number)
    for name, (zeros, ones) in catalog.CODES.items():
        number = F.when(F.col("feature") == name, X.recode(F.col("value"), number, zeros, ones)).otherwise(number)
    marked = joined.withColumn("valuenum", number)
    unit_ok = (F.size("units") == 0) | F.coalesce(F.array_contains("units", F.col("valueuom")), F.lit(False))
    ok = (unit_ok & X.in_range(F.col("valuenum"), F.col("low"), F.col("high"))) | (F.col("zero_ok") & F.coalesce(F.col("valuenum") == 0, F.lit(False)))
    marked = marked.withColumn("ok", ok).filter((F.col("policy") != catalog.DROP) | F.col("ok"))
    middle = small(medians(marked.filter(F.col("policy") == catalog.MEDIAN), "feature", "valuenum", F.col("ok")))
    filled = marked.join(middle, "feature", "left")
    value = F.when((F.col("policy") == catalog.MEDIAN) & ~F.col("ok"), F.col("median")).otherwise(F.col("valuenum"))
    text = F.when(F.col("feature").isin(*catalog.CODES), F.col("value"))
    return filled.select(*[c for c in events.columns if c not in ("value", "valuenum", "valueuom")], text.alias("value"), value.alias("valuenum"), F.col("unit").alias("valueuom"), F.col("feature").alias("name"))


def normalise_input_units(df: DataFrame, value: str = "valuenum", unit: str = "valueuom") -> DataFrame:
    new_value, new_unit = X.to_milligrams(F.col(value), F.col(unit))
    return df.withColumns({value: new_value, unit: new_unit})


def item_labels(events: DataFrame, items: DataFrame) -> DataFrame:
    """itemid and label of the items that events have; an item without a row or a label has an empty one."""
    used = events.select("itemid").filter("itemid is not null").distinct()
    return used.join(small(items.select("itemid", "label")), "itemid", "left").withColumn("label", F.coalesce("label", F.lit("")))


def number_for_text(df: DataFrame, text: str = "value", number: str = "valuenum") -> DataFrame:
    """The number that a text column holds in a column of its own, and no text."""
    return df.withColumns({number: F.col(text).try_cast("double"), text: F.lit(None).cast("string")})


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the missing values of each column, and the rows."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns), F.count(F.lit(1)).alias("rows"))


def required(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df as it is; reading a row that doesn't meet the condition raises with the message."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
