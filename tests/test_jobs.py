import datetime
import json
import os
import random
import statistics
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import minute_loads, note_features, queries
from tidewell.streaming.loads import Loads

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CONFIG = minute_loads.read_config() | {"files_per_load": 1}

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def event_rows(seed, n, first_day=1, days=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = datetime.datetime(2024, 1, first_day + rng.randrange(days), rng.randrange(2), rng.randrange(3), rng.randrange(60))
        out.append((i, at, rng.randrange(4), rng.choice(["a", "b"]), float(rng.randrange(8)), None))
    return out


def put(spark, rows, folder, name):
    """Rows as one more file of the folder."""
    there = f"{folder}-{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(there)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(there) if f.endswith(".parquet"))
    os.rename(f"{there}/{part}", f"{folder}/{name}.parquet")


def by_hand(rows):
    valid = [r for r in rows if r[1] is not None and r[2] is not None and r[3] is not None and r[4] is not None and 0 <= r[4] <= 390]
    values, minutes = {}, {}
    for _, at, stay, variable, value, _ in valid:
        values.setdefault(variable, []).append(value)
        minutes.setdefault((stay, at.replace(second=0, microsecond=0), variable), set()).add(value)
    return {key + (round(sum(v) / len(v), 9), statistics.median(values[key[2]]), len(values[key[2]])) for key, v in minutes.items()}


def held(df):
    return {(r["stay_id"], r["minute"], r["variable"], round(r["value"], 9), r["median"], r["n"]) for r in df.collect()}


def test_loads_of_growing_input(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = event_rows(1, 60) + [(0, None, 1, "a", 1.0, None), (0, datetime.datetime(2024, 1, 1), None, "a", 1.0, None), (0, datetime.datetime(2024, 1, 1), 1, None, 1.0, None)]
    first += [(0, datetime.datetime(2024, 1, 1), 1, "a", v, None) for v in (None, float("nan"), -1.0, 390.5, 390.0)]
    second, third = event_rows(2, 50, 2, 3), event_rows(3, 40, 20, 2)
    put(spark, first, source, "a")
    assert held(minute_loads.run(spark, source, out, CONFIG)) == by_hand(first)
    assert held(minute_loads.run(spark, source, out, CONFIG)) == by_hand(first)  # nothing new
    put(spark, second, source, "b")
    put(spark, third, source, "c")
    taken = []
    real = Loads.refresh

    def breaks(self, session, days):
        taken.append(days)
        if len(taken) == 1:
            raise OSError("lost")
        return real(self, session, days)

    monkeypatch.setattr(Loads, "refresh", breaks)
    with pytest.raises(Exception, match="lost"):
        minute_loads.run(spark, source, out, CONFIG)
    assert held(minute_loads.run(spark, source, out, CONFIG)) == by_hand(first + second + third)
    assert taken[0] == taken[1] and taken[0] != taken[2]  # the load that broke off came again, then the other
    loads = sorted(r["load"] for r in Loads(out).read(spark, "events").select("load").distinct().collect())
    assert loads == [0, 1, 2]


def test_a_load_leaves_other_days_alone(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, event_rows(1, 40), source, "a")
    minute_loads.run(spark, source, out, CONFIG)
    files = lambda: {r["f"]: r["t"] for r in spark.read.parquet(f"{out}/minutes").select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}
    before = files()
    put(spark, event_rows(4, 10, 25, 1), source, "b")
    minute_loads.run(spark, source, out, CONFIG)
    after = files()
    assert before.items() < after.items()


def test_medians_read_no_old_rows(spark, tmp_path):
    loads = Loads(str(tmp_path / "t"))
    rng, all_values = random.Random(3), []
    for k in range(3):
        values = [float(rng.randrange(30)) for _ in range(7 + k)]
        all_values += values
        rows = [(1, datetime.datetime(2024, 1, 1, 0, k), "a", v) for v in values]
        loads.add(spark.createDataFrame(rows, "stay_id long, charttime timestamp_ntz, variable string, value double"), k)
    medians = loads.medians(spark)
    assert [tuple(r) for r in medians.collect()] == [("a", len(all_values), statistics.median(all_values))]
    assert "events" not in medians._jdf.queryExecution().optimizedPlan().toString().replace("pytest", "")
    again = loads.add(spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, 2), "a", 1.0)] * 2, "stay_id long, charttime timestamp_ntz, variable string, value double"), 2)
    assert again["read"] == 2 and again["events"] == 1  # a load replaces itself
    assert medians.sparkSession.read.parquet(f"{loads.folder}/counts").agg(F.sum("n")).first()[0] == 7 + 8 + 2


def test_empty_source(spark, tmp_path):
    put(spark, [], str(tmp_path / "in"), "a")
    assert minute_loads.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), CONFIG).count() == 0


NOTES = [(1, "Call me: a@b 12, 13", "en", "x"), (2, "Call me: a@b 12, 13", "en", "x"), (3, "Call me: a@b 12, 13", "fr", "x"), (4, "", "en", "y"), (5, None, "en", "y"), (6, "one", "en", None), (7, "LICENSED under\tno\nlaw é", None, "z")]
TURNS = [(1, 0, "user", "hi 5"), (1, 1, "user", "hi 5"), (2, 0, "user", None), (3, 0, "user", "pass password")]


def note_tables(spark, folder, notes=NOTES, turns=TURNS):
    spark.createDataFrame(notes, "doc_id long, text string, lang string, source string").withColumn("score", F.lit(1)).write.parquet(f"{folder}/d")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/c")
    return f"{folder}/d", f"{folder}/c"


def test_notes_against_brute_force(spark, tmp_path):
    where = note_tables(spark, tmp_path)
    config = note_features.read_config()
    made = [sorted(map(tuple, note_features.run(spark, *where, str(tmp_path / "out"), config).collect()), key=str) for _ in range(2)]
    assert made[0] == made[1]
    want = {}
    for i, text, lang, source in NOTES:
        if text is not None and source is not None:
            want.setdefault(("document", f"s:{source}", lang, text), []).append((i, 0))
    for i, turn, _, text in TURNS:
        if text is not None:
            want.setdefault(("conversation", f"c:{i}", None, text), []).append((i, turn))
    rows = {}
    for (kind, subject, lang, text), ids in want.items():
        for name in (*config["keywords"], "words", "numbers", "characters"):
            if name in config["keywords"]:
                value = float(any(w in text.lower() for w in config["keywords"][name]))
            else:
                value = float({"words": len(text.split()), "characters": len(text), "numbers": sum(c.isdigit() and not (k and text[k - 1].isdigit()) for k, c in enumerate(text))}[name])
            rows[(*min(ids), subject, lang, name, kind)] = value
    got = {(i, part, subject, lang, name, kind): value for i, part, subject, lang, name, value, _, _, kind in made[0]}
    assert got == rows
    split_of = {subject: part for _, _, subject, _, _, _, _, part, _ in made[0]}
    for _, _, subject, _, name, value, score, part, _ in made[0]:
        assert part == split_of[subject]
        train = [v for (_, _, s, _, n, _), v in rows.items() if n == name and split_of[s] == "train"]
        assert score == pytest.approx((value - statistics.mean(train)) / (statistics.pstdev(train) or 1), abs=1e-6)


def test_no_notes(spark, tmp_path):
    where = note_tables(spark, tmp_path, [], [])
    assert note_features.run(spark, *where, str(tmp_path / "out")).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("events", "documents", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) and a.equals(b)


@needs_data
def test_command_line(spark, tmp_path):
    put(spark, event_rows(1, 20), str(tmp_path / "in"), "a")
    config = tmp_path / "config.json"
    config.write_text(json.dumps(CONFIG))
    done = subprocess.run([sys.executable, "-m", "jobs.minute_loads", str(tmp_path / "in"), f"file:{tmp_path}/out", "--config", str(config)], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr
    assert "load 0: read 20 rows" in done.stderr and "minutes" in done.stderr


def test_jobs_stand_alone():
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            with open(f"{ROOT}/jobs/{name}") as f:
                text = f.read()
            assert "llm" not in text and "corpus_pipeline" not in text
