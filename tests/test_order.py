import csv
import random

from pyspark.sql import functions as F

from tidewell.functions.schemas import struct
from tidewell.operators import numbering
from tidewell.sources import epochs
from tidewell.sources.tables import read_csv


def test_places_are_those_in_the_files(spark, tmp_path):
    rng, rows = random.Random(1), []
    for part in range(3):
        own = [[rng.randrange(50), rng.choice(["x", "", "NA"])] for _ in range(400 * (3 - part))]
        with open(tmp_path / f"t{part}.csv", "w", newline="") as f:
            csv.writer(f).writerows([["id", "text"], *own])
        rows += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        df = read_csv(spark, str(tmp_path / "t*.csv"), struct("id long, text string"), "place")
        assert df.select("id").rdd.getNumPartitions() >= 3
        got = sorted((r["place"], r["id"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, row[0]) for i, row in enumerate(rows)]


def test_rank_of_keys_far_apart(spark):
    rng = random.Random(2)
    keys = [rng.choice([0, 1, 5, 6, 7, 10**15, None]) for _ in range(300)] + [-(10**17)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, tie int").repartition(5)
    want = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    got = {r["tie"]: r["place"] for r in numbering.ordered_rank(df, "key", "tie", buckets=8).collect()}
    assert [got[i] for i in want] == list(range(len(keys)))
    assert numbering.ordered_rank(df.limit(0), "key", "tie").count() == 0
    one = numbering.ordered_rank(df.filter("key IS NULL"), "key", "tie")
    assert sorted(r["place"] for r in one.collect()) == list(range(keys.count(None)))


def test_a_far_key_does_not_fill_one_bucket(spark):
    df = spark.range(4000).select(F.when(F.col("id") == 7, 10**16).otherwise(F.col("id")).alias("key"))
    plan = numbering.ordered_rank(df, "key", buckets=64)
    assert plan.filter("key = 10000000000000000").first()["place"] == 3999
    found = df.agg(F.percentile_approx("key", F.array(*(F.lit(i / 64) for i in range(1, 64))), 256).alias("q")).first()["q"]
    assert len(set(found)) == 63


def test_readers_share_an_epoch(spark, tmp_path):
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(103)], "id long, text string")
    order = {}
    for run in ("a", "b"):
        epochs.write_epoch(samples.repartition(3 if run == "a" else 5), "id", 7, 2, str(tmp_path / run), size=10, readers=2)
        seen = []
        for reader in range(2):
            rows = epochs.read_epoch(spark, str(tmp_path / run), reader).orderBy("batch", "slot").collect()
            assert {r["batch"] % 2 for r in rows} == {reader}
            seen += [(r["batch"], r["slot"], r["id"]) for r in rows]
        order[run] = sorted(seen)
    assert order["a"] == order["b"] and sorted(i for _, _, i in order["a"]) == list(range(103))
    assert [(b, s) for b, s, _ in order["a"]] == [(i // 10, i % 10) for i in range(103)]
    rest = epochs.read_epoch(spark, str(tmp_path / "a"), 1, first=5).collect()
    assert {r["batch"] for r in rest} == {5, 7, 9} and len(rest) == 30
    counts = {(r["reader"], r["batch"]): r["rows"] for r in epochs.manifest(spark, str(tmp_path / "a")).collect()}
    assert counts == {(b % 2, b): 10 if b < 10 else 3 for b in range(11)}
    epochs.write_epoch(samples, "id", 7, 3, str(tmp_path / "c"), size=10)
    assert [r["id"] for r in epochs.read_epoch(spark, str(tmp_path / "c")).orderBy("batch", "slot").collect()] != [i for _, _, i in order["a"]]
