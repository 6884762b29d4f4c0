import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import align, windows
from tidewell.streaming import minutes

BASE = dt.datetime(2024, 3, 1)
SCHEMA = "stay_id long, ts timestamp, variable string, value double, source string, intime timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
TARGETS = ["a", "b"]


@pytest.fixture()
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def stream(spark, folder, parts):
    """A stream that takes one part of the rows at a time."""
    os.makedirs(folder)
    for i, part in enumerate(parts):
        there = f"{folder}-{i}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(there)
        name = next(f for f in os.listdir(there) if f.endswith(".parquet"))
        os.rename(f"{there}/{name}", f"{folder}/{i:03}.parquet")
        os.utime(f"{folder}/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, folder, name):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def far(days=30):
    """A row that moves the watermark beyond all others."""
    at = BASE + dt.timedelta(days=days)
    return (-1, at, "z", 0.0, "s", at)


def stays(seed, n=12):
    rng = random.Random(seed)
    rows = []
    for stay in range(n):
        start = BASE + dt.timedelta(minutes=rng.randrange(200), seconds=rng.randrange(60))
        for _ in range(rng.randrange(3, 40)):
            at = start + dt.timedelta(minutes=rng.randrange(-3, 110), seconds=rng.randrange(60))
            rows.append((stay, at, rng.choice(["a", "b", "z"]), float(rng.randrange(3)), rng.choice("st"), start))
    return rows


def batch_windows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    timed = df.withColumn("minute", F.floor((F.unix_micros("ts") - F.unix_micros("intime")) / 60_000_000).cast("long")).filter("minute >= 0")
    return {tuple(r) for r in windows.first_windows(align.minute_means(timed), TARGETS).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_first_windows_equal_the_batch(rocks, tmp_path, seed):
    rows = stays(seed)
    rng = random.Random(seed)
    sent = rows + rng.choices(rows, k=30)  # repeats
    rng.shuffle(sent)  # within the ten hours that rows may be late
    size = len(sent) // 4 + 1
    parts = [sent[i : i + size] for i in range(0, len(sent), size)] + [[far()], [far(31)]]
    found = run(minutes.first_windows(stream(rocks, str(tmp_path / "in"), parts), TARGETS, late="10 hours"), tmp_path, f"w{seed}")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == batch_windows(rocks, rows) and got


def test_rows_after_the_watermark_are_not_seen(rocks, tmp_path):
    rows = [(1, BASE + dt.timedelta(minutes=m), v, 1.0, "s", BASE) for m, v in ((5, "z"), (31, "a"), (33, "a"), (60, "z"), (45, "b"), (47, "b"), (90, "z"))]
    early = (1, BASE + dt.timedelta(minutes=2), "z", 1.0, "s", BASE)
    late_rows = [(2, BASE + dt.timedelta(minutes=m), "a", 1.0, "s", BASE) for m in (1, 31, 33, 60)]
    parts = [[early, *rows], [far()], late_rows, [far(31)]]
    found = run(minutes.first_windows(stream(rocks, str(tmp_path / "in"), parts), TARGETS, late="5 minutes"), tmp_path, "late")
    assert [tuple(r) for r in found.collect()] == [(1, 0)]


def test_minute_means_equal_the_batch(rocks, tmp_path):
    rows = stays(5)
    rng = random.Random(5)
    sent = [r if rng.random() > 0.1 else (*r[:3], rng.choice([None, float("nan")]), *r[4:]) for r in rows]
    sent += rng.choices(sent, k=60) + [(None, BASE, "a", 1.0, "s", BASE), (1, BASE, None, 1.0, "s", BASE)]
    batch = rocks.createDataFrame(sent, SCHEMA).withColumn("minute", F.date_trunc("minute", "ts"))
    want = align.minute_means(align.distinct_events(batch, "stay_id", "minute", "variable", "value", "source"))
    rng.shuffle(sent)
    size = len(sent) // 3 + 1
    parts = [sent[i : i + size] for i in range(0, len(sent), size)] + [[far()], [far(31)]]
    found = run(minutes.minute_means(stream(rocks, str(tmp_path / "in"), parts), late="10 hours", source="source"), tmp_path, "means")
    rounded = lambda df, minute: {(r["stay_id"], r[minute], r["variable"], None if r["value"] is None or r["value"] != r["value"] else round(r["value"], 9)) for r in df.collect()}
    assert {r for r in rounded(found, "minute_start") if r[0] != -1} == rounded(want, "minute")
