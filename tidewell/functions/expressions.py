"""Scalar expressions that the stages share. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(value: Column) -> Column:
    """Null or NaN."""
    return value.isNull() | F.isnan(value)


def in_range(value: Column, low, high) -> Column:
    """Inclusive range test that is false, never null, for a missing value or bound."""
    return F.coalesce(~missing(value) & (value >= low) & (value <= high), F.lit(False))


def fraction(value: Column) -> Column:
    """Percentages over 1 as fractions; values up to 1 are fractions already."""
    return F.when(value > 1.0, value / 100).otherwise(value)


def to_milligrams(value: Column, unit: Column) -> tuple[Column, Column]:
    """Value and unit with micrograms as mg and litres as ml; both are computed from the old unit."""
    return (
        F.when(unit == "mcg", value * 0.001).when(unit == "L", value * 1000.0).otherwise(value),
        F.when(unit == "mcg", "mg").when(unit == "L", "ml").otherwise(unit),
    )


def recode(text: Column, number: Column, zeros: list[str], ones: list[str]) -> Column:
    """0 and 1 for the listed texts; any other text keeps its number."""
    return F.when(text.isin(zeros), F.lit(0.0)).when(text.isin(ones), F.lit(1.0)).otherwise(number)


def binary(value: Column) -> Column:
    """1 for values over 0; NaN stays NaN."""
    return F.when(~F.isnan(value) & (value > 0), F.lit(1.0)).otherwise(value)


def relative_minute(start: Column, at: Column) -> Column:
    """Whole minutes from start, rounded down; negative before it."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, at) / F.lit(60_000_000)).cast("long")


def age_at(anchor_age: Column, anchor_year: Column, at: Column) -> Column:
    return anchor_age + F.year(at) - anchor_year


def contains_any(label: Column, keywords: list[str]) -> Column:
    """The lower-cased label holds one of the keywords; a missing label holds none."""
    low = F.lower(F.coalesce(label, F.lit("")))
    found = F.lit(False)
    for word in keywords:
        found = found | low.contains(word)
    return found


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Standard score; a zero deviation counts as 1, a variable without a mean is 0."""
    return F.when(F.coalesce(F.isnan(mean) | mean.isNull(), F.lit(True)), F.lit(0.0)).otherwise((value - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std))


def unscale(value: Column, mean: Column, std: Column) -> Column:
    """The inverse of zscore for a variable that has a mean."""
    return value * F.when(std == 0, F.lit(1.0)).otherwise(std) + mean


def parsed(text: Column, kind: str) -> Column:
    """A text as a value of a type, null where it doesn't parse or says that it is missing; whole numbers may have decimals of zero."""
    present = F.when(~F.trim(text).isin("", "NA", "NaN", "nan", "NULL", "null", "N/A", "n/a"), text)
    if kind == "string":
        return present
    return present.try_cast("double").try_cast(kind) if kind in ("bigint", "int") else present.try_cast(kind)
