import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import catalog, expressions as X
from tidewell.operators import align, extract, metrics, normalise, split, triplets, windows

DAY = dt.datetime(2020, 1, 1)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_conditional_median(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 10.0, None, 999.0)] + [("b", 999.0), ("b", None)], "g string, v double")
    got = extract.impute_median(df, "g", "v", X.in_range(F.col("v"), 0, 100))
    assert rows(got.filter("g = 'a'"), "v") == [(1.0,), (10.0,), (2.0,), (3.0,), (3.0,), (4.0,)]
    assert rows(got.filter("g = 'b'"), "v") == [(None,), (None,)]


def test_hourly_split(spark):
    def t(minutes):
        return DAY + dt.timedelta(minutes=minutes)

    data = [(1, t(0), t(125.25), 3.0), (2, t(0), t(60), 6.0), (3, t(0), t(180), 6.0), (4, t(10), t(0), 5.0), (5, t(0), None, 1.0)]
    df = spark.createDataFrame(data, "id int, starttime timestamp_ntz, endtime timestamp_ntz, amount double")
    got = {}
    for i, at, amount in rows(extract.split_hourly(df), "id", "charttime", "amount"):
        got.setdefault(i, []).append((at, amount))
    assert [a for a, _ in got[1]] == [t(60), t(120), t(125.25)]
    assert got[1][0][1] == pytest.approx(180 / 125.25) and sum(x for _, x in got[1]) == pytest.approx(3)
    assert got[2] == [(t(60), 6.0)] and len(got[3]) == 3 and got[4] == [(t(0), 5.0)] and 5 not in got


def test_rules(spark):
    rules = catalog.rule_table(spark)
    items = catalog.item_table(spark.createDataFrame([("HR", 1), ("Temperature", 223761), ("FiO2", 2), ("CRR", 3), ("Furosemide", 4), ("Pantoprazole", 5)], "feature string, itemid long"))
    data = [
        ("chart", 1, None, 390.0, None), ("chart", 1, None, 391.0, None), ("lab", 1, None, 80.0, None), ("chart", 223761, None, 98.6, None), ("chart", 223761, None, 32.0, None),
        ("chart", 2, None, 50.0, None), ("chart", 2, None, 0.1, None), ("chart", 3, "Other/Remarks", 1.0, None), ("chart", 3, "Normal <3 secs", None, None), ("chart", 3, None, 2.0, None),
        ("input", 4, None, 0.0, "ml"), ("input", 4, None, 5.0, "mg"), ("input", 4, None, 5.0, "ml"), ("input", 5, None, 40.0, "mg"),
    ]
    events = spark.createDataFrame(data, "source string, itemid long, value string, valuenum double, valueuom string")
    got = {}
    for name, value in rows(extract.apply_rules(events, items, rules), "name", "valuenum"):
        got.setdefault(name, []).append(value)
    assert got["HR"] == [390.0] and got["FiO2"] == [0.5] and got["CRR"] == [0.0, 2.0] and got["Pantoprazole"] == [1.0]
    assert got["Temperature"] == [pytest.approx(37)] and sorted(got["Furosemide"]) == [0.0, 2.5, 5.0]


def test_assign_stay(spark):
    stays = spark.createDataFrame(
        [(1, 10, DAY, DAY + dt.timedelta(days=2), 0), (1, 11, DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=3), 1), (2, 12, DAY, DAY, 2)],
        "hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz, stay_ord int",
    )
    data = [(1, 0, 0), (2, 0, 2), (3, 0, 1), (4, 0, 3), (5, 0, 4), (6, 1, 0)]
    labs = spark.createDataFrame([(i, 1 + a, DAY + dt.timedelta(days=d)) for i, a, d in data], "id int, hadm_id long, charttime timestamp_ntz")
    assert rows(align.assign_stay(labs, stays), "id", "stay_id") == [(1, 10), (2, 10), (3, 10), (4, 11), (6, 12)]


def test_dedupe_then_mean(spark):
    data = [("chart", 5.0), ("chart", 5.0), ("chart", 8.0)]
    df = spark.createDataFrame([(1, 0, "HR", v, s) for s, v in data] + [(2, 0, "HR", v, s) for s, v in [*data[1:], ("lab", 5.0)]] + [(3, 0, "HR", None, "chart")], "stay_id long, minute long, variable string, value double, source string")
    got = dict(rows(align.minute_means(align.distinct_events(df, *df.columns)), "stay_id", "value"))
    assert got[1] == 6.5 and got[2] == 6 and math.isnan(got[3])


def test_target_must_exist(spark):
    with pytest.raises(ValueError):
        align.variable_index(spark.createDataFrame([("a",)], "name string"), ["b"])


def brute_first(events, targets):
    last, t = max(m for m, _ in events), 0
    while t + 40 < last:
        inside = [v for m, v in events if t + 30 <= m < t + 40 and v in targets]
        if any(inside.count(v) > 1 for v in targets) and any(t <= m < t + 30 for m, _ in events):
            return t // 10
        t += 10
    return None


def test_first_window_against_brute_force(spark):
    rng, data, want = random.Random(3), [], set()
    for stay in range(120):
        events = {(rng.randrange(-5, 130), rng.choice("abcd")) for _ in range(rng.randrange(1, 60))}
        data += [(stay, m, v, 1.0) for m, v in events]
        if (k := brute_first(events, ["a", "b"])) is not None:
            want.add((stay, k))
    df = spark.createDataFrame(data, "stay_id long, minute long, variable string, value double")
    assert set(rows(windows.first_windows(df, ["a", "b"]), "stay_id", "k")) == want and len(want) > 10


def test_strict_end_of_window(spark):
    base = [(3, "a"), (31, "a"), (32, "a")]
    for end, found in ((40, []), (41, [(1, 0)])):
        df = spark.createDataFrame([(1, m, v, 0.0) for m, v in [*base, (end, "z")]], "stay_id long, minute long, variable string, value double")
        assert rows(windows.first_windows(df, ["a"]), "stay_id", "k") == found


def test_split_sizes(spark):
    got = split.split_subjects(spark.range(25).withColumnRenamed("id", "subject_id"), 2026)
    assert sorted(r["count"] for r in got.groupBy("split").count().collect()) == [4, 5, 16]
    assert rows(got, "subject_id", "split") == rows(split.split_subjects(spark.range(25).withColumnRenamed("id", "subject_id"), 2026), "subject_id", "split")
    with pytest.raises(ValueError):
        split.split_subjects(spark.range(1).withColumnRenamed("id", "subject_id"), -1)
    assert split.check_seed({"split_seed": 1}, 1) and not split.check_seed(None, 1)
    with pytest.raises(ValueError):
        split.check_seed({"split_seed": 2}, 1)


def test_stats_and_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", math.nan), ("c", 1.0)], "variable string, value double")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "variable string")
    stats = normalise.fit_stats(df, names)
    got = {r["variable"]: (r["mean"], r["std"], r["n"]) for r in stats.collect()}
    assert got["a"] == (2.0, 1.0, 2) and got["b"] == (2.0, 0.0, 1) and math.isnan(got["c"][0]) and math.isnan(got["d"][0]) and got["d"][2] == 0
    assert rows(normalise.scale(df, stats), "variable", "value") == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("c", 0.0), ("c", 0.0)]
    back = normalise.unscale(normalise.scale(df.filter("variable < 'c'"), stats), stats)
    assert rows(back, "variable", "value") == rows(df.filter("variable < 'c'"), "variable", "value")


def greedy(events, targets, interventions, size, seed, sample):
    """Places of the chosen events (vind of each), by a plain loop."""
    if len(events) <= size:
        return set(range(len(events)))
    last = lambda v, n: [i for i, x in enumerate(events) if x == v][-n:]
    chosen = set(sorted({i for v in targets for i in last(v, 3)} | {i for v in interventions for i in last(v, 1)})[-size:])
    still = list(targets)
    while len(chosen) < size and still:
        counts = [sum(events[i] == v for i in chosen) for v in still]
        k = next((j for j in range(len(still) - 1) if counts[j] <= counts[j + 1]), len(still) - 1)
        unused = [i for i, x in enumerate(events) if x == still[k] and i not in chosen]
        if unused:
            chosen.add(unused[0])
        else:
            still.pop(k)
    rest = sorted((i for i in range(len(events)) if i not in chosen), key=lambda i: hashlib.md5(f"{seed}:{sample}:{i}".encode()).hexdigest())
    return chosen | set(rest[: size - len(chosen)])


@pytest.mark.parametrize("targets, interventions, size", [([0, 1, 2], [5], 12), ([2, 0], [0, 4], 7), ([1], [], 3), ([], [3], 5), ([0, 1, 2, 3], [4, 5], 30)])
def test_balanced_equals_a_plain_loop(spark, targets, interventions, size):
    rng = random.Random(size)
    samples = {s: [rng.choice([0, 0, 1, 2, 2, 2, 3, 4, 5, 6]) for _ in range(rng.randrange(1, 60))] for s in range(25)}
    minutes = {s: sorted(rng.randrange(30) for _ in events) for s, events in samples.items()}
    data = [(s, p, v, minutes[s][p], float(p)) for s, events in samples.items() for p, v in enumerate(events)]
    df = spark.createDataFrame(data, "stay_id long, pos int, vind int, minute long, value double")
    made = triplets.balanced(df, "stay_id", targets, interventions, size, seed=5)
    got = {}
    for r in made.orderBy("stay_id", "slot").collect():
        got.setdefault(r["stay_id"], []).append(r["pos"])
        assert r["slot"] == len(got[r["stay_id"]]) - 1 and r["vind"] == samples[r["stay_id"]][r["pos"]]
    for s, events in samples.items():
        want = greedy(events, targets, interventions, size, 5, s)
        order = sorted(want) if len(events) <= size else sorted(want, key=lambda i: (minutes[s][i], events[i], i))
        assert got[s] == order


def test_balanced_plan_has_one_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 1.0)], "stay_id long, pos int, vind int, minute long, value double")
    made = triplets.balanced(df, "stay_id", [0], [2], size=8)
    assert made.count() == 1
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Pandas" not in plan
    assert triplets.balanced(df.filter("pos > 0"), "stay_id", [0], [2]).count() == 0


def test_crps_is_zero_for_certain_draws(spark):
    df = spark.createDataFrame([(1, 2.0, [2.0] * 10), (2, -1.0, [-1.0] * 10)], "id long, actual double, draws array<double>")
    q = metrics.quantiles(metrics.long_draws(df, ["id", "actual"]), ["id", "actual"], metrics.VALID_LEVELS).withColumns({"mask": F.lit(1.0), "run": F.lit(0)})
    assert metrics.quantile_crps(q, ["run"]).first()["crps"] == 0
    zero = q.withColumn("actual", F.lit(0.0))
    assert metrics.quantile_crps(zero, ["run"]).first()["crps"] is None
