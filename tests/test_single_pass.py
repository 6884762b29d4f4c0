"""Samples are made in one pass: as many tasks as the session names, the same rows as by joins, no step done twice."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import align, forecast, triplets, windows
from tidewell.plans import registry

DATA = "/root/testdata/sf0.001"
TARGETS = ["a", "b"]
QUERIES = ["window_samples", "last_n_per_target", "empirical_forecast", "sample_lengths", "target_arrays"]


def minute_rows(spark):
    rng = random.Random(5)
    rows = {(s, m, v): rng.choice([1.0, 2.5, None, float("nan")]) for s in (None, *range(40)) for m in rng.sample(range(-20, 160), rng.randrange(1, 60)) for v in rng.sample("abcd", 2)}
    return spark.createDataFrame([(s, m, v, x, "y") for (s, m, v), x in rows.items()], "stay_id long, minute long, variable string, value double, more string").repartition(5)


def as_text(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("targets", [TARGETS, ["d"], []])
def test_first_window_rows_equal_the_joined_windows(spark, targets):
    minutes = minute_rows(spark)
    want = as_text(windows.window_rows(minutes, targets, windows.first_windows(minutes, targets), carry=("more",)))
    assert as_text(windows.first_window_rows(minutes, targets, carry=("more",))) == want
    assert bool(want) == bool(targets)


def test_dealt_minutes_equal_the_joined_ones(spark):
    rows = [(s, f"2024-01-0{1 + s % 3} 0{i}:10:0{i}" if i else None, i) for s in range(6) for i in range(4)] + [(None, "2024-01-01 00:00:00", 9)]
    events = spark.createDataFrame(rows, "stay_id long, at string, i int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert as_text(align.dealt_minutes(events, "stay_id", "at")) == as_text(align.minutes_since_first(events, "stay_id", "at"))


def test_recent_rows_by_hand(spark):
    rng, rows = random.Random(2), []
    for s in range(12):
        at = sorted((rng.randrange(30), rng.randrange(6)) for _ in range(rng.randrange(1, 30)))
        rows += [(s, i, v, m, float(i)) for i, (m, v) in enumerate(at)]
    want = []
    for s in range(12):
        own = [r for r in rows if r[0] == s]
        kept = [r for v, n in ((0, 3), (1, 3), (4, 3), (2, 1)) for r in sorted((x for x in own if x[2] == v), key=lambda x: x[1])[-n:]]
        want += sorted(kept, key=lambda r: r[1])[-5:]
    got = triplets.recent_rows(spark.createDataFrame(rows, "stay_id long, pos int, vind int, minute long, value double"), "stay_id", [0, 1, 4], [2, 4], size=5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_draws_come_from_the_known_history_only(spark):
    rows = [(1, 0, 0, 1, 0, 5.0), (1, 1, 0, 2, 0, None), (1, 2, 0, 31, 1, 7.0), (1, 3, 2, 32, 1, 8.0), (2, 0, 0, 31, 1, 9.0), (None, 0, 0, 1, 0, 3.0), (None, 1, 0, 31, 1, 4.0), (3, 0, None, 1, 0, 3.0), (3, 1, None, 31, 1, 4.0)]
    made = forecast.EmpiricalForecaster(1).forecast(spark.createDataFrame(rows, "stay_id long, pos int, vind int, minute long, is_target int, value double"), 4)
    assert made.columns == ["stay_id", "pos", "vind", "minute", "actual", "draws"]
    assert {(r["stay_id"], r["pos"]): r["draws"] for r in made.collect()} == {(1, 2): [5.0] * 4, (1, 3): [0.0] * 4, (2, 0): [0.0] * 4, (None, 1): [0.0] * 4, (3, 1): [0.0] * 4}


@pytest.mark.parametrize("name", QUERIES)
def test_events_are_read_and_dealt_once_over_all_tasks(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = registry.QUERIES[name](spark, DATA)
        assert df.rdd.getNumPartitions() == 13  # adaptive execution has not merged the small tasks
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "Union" not in plan and "SortMergeJoin" not in plan
