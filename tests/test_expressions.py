import math

from pyspark.sql import functions as F

from tidewell.functions import catalog, expressions as X


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, expression):
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_in_range_is_never_null(spark):
    df = column(spark, [-1.0, 0.0, 390.0, 390.1, None, math.nan])
    assert values(df, X.in_range(F.col("v"), 0, 390)) == [False, True, True, False, False, False]


def test_fraction(spark):
    assert values(column(spark, [50.0, 0.5, 1.0, None]), X.fraction(F.col("v"))) == [0.5, 0.5, 1.0, None]


def test_units_use_the_old_unit(spark):
    df = spark.createDataFrame([(0, 1000.0, "mcg"), (1, 2.0, "L"), (2, 2.0, "mL"), (3, 2.0, None)], "i int, v double, u string")
    value, unit = X.to_milligrams(F.col("v"), F.col("u"))
    got = [(r["a"], r["b"]) for r in df.select("i", value.alias("a"), unit.alias("b")).orderBy("i").collect()]
    assert got == [(1.0, "mg"), (2000.0, "ml"), (2.0, "mL"), (2.0, None)]


def test_recode_and_binary(spark):
    df = spark.createDataFrame([(0, "no", 5.0), (1, "yes", None), (2, "zzz", 7.0), (3, None, 2.0)], "i int, t string, v double")
    assert values(df, X.recode(F.col("t"), F.col("v"), ["no"], ["yes"])) == [0.0, 1.0, 7.0, 2.0]
    got = values(column(spark, [3.0, 0.0, -1.0, None, math.nan]), X.binary(F.col("v")))
    assert got[:4] == [1.0, 0.0, -1.0, None] and math.isnan(got[4])


def test_relative_minute_rounds_down(spark):
    df = spark.sql(
        "SELECT i, timestamp_ntz'2020-01-01 00:01:01.5' AS a, timestamp_ntz'2020-01-01 00:01:01.5' + make_dt_interval(0, 0, 0, s) AS b "
        "FROM VALUES (0, -0.5), (1, -61), (2, 59.9), (3, 60) AS t(i, s)"
    )
    assert values(df, X.relative_minute(F.col("a"), F.col("b"))) == [-1, -2, 0, 1]


def test_contains_any(spark):
    df = column(spark, ["Foley Cath", "Chest", None], "string")
    assert values(df, X.contains_any(F.col("v"), ["foley", "void"])) == [True, False, False]


def test_zscore_edges(spark):
    df = spark.createDataFrame([(0, 5.0, 3.0, 2.0), (1, 5.0, 3.0, 0.0), (2, 5.0, math.nan, math.nan), (3, 5.0, None, None)], "i int, v double, m double, s double")
    assert values(df, X.zscore(F.col("v"), F.col("m"), F.col("s"))) == [1.0, 2.0, 0.0, 0.0]


def test_catalog_is_whole():
    rules = catalog.rules()
    assert len({r.feature for r in rules}) == len(rules) == 129
    names = {r.feature for r in rules}
    assert names.issuperset(catalog.TARGETS) and names.issuperset(catalog.INTERVENTIONS) and len(catalog.INTERVENTIONS) == 18
