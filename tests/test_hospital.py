import csv
import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tidewell import cli
from tidewell.functions import catalog
from tidewell.functions.schemas import INPUTS
from tidewell.operators import split
from tidewell.operators.forecast import DiffusionForecaster, EmpiricalForecaster, schedule
from tidewell.plans import hospital
from tidewell.sources import tables
from tidewell.sources.stages import StageError
from tidewell.streaming import minutes as stream

START = dt.datetime(2150, 3, 1, 8)
ITEMS = {"HR": 220045, "SBP": 220179, "DBP": 220180, "Temperature": 223761, "O2 Saturation": 220277, "FiO2": 223835, "Lactate": 50813, "Furosemide": 221794, "Weight": 224639}


def at(minutes):
    return (START + dt.timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S")


def write(folder, name, columns, rows):
    path = os.path.join(folder, "icu" if name in ("icustays", "chartevents", "outputevents", "d_items", "inputevents") else "hosp")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"{name}.csv"), "w", newline="") as f:
        csv.writer(f).writerows([columns, *rows])


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    stays, patients, chart, labs, given, outs = [], [], [], [], [], []
    for s in range(1, 9):
        stays.append([s, 100 + s, 1000 + s, at(0), at(600), "unit", "extra"])
        patients.append([s, "M" if s % 2 else "F", 17 if s == 8 else 50 + s, 2150, ""])
        for m in range(0, 90, 2):
            chart.append([100 + s, 1000 + s, at(m), ITEMS["HR"], str(60 + m + s), 60 + m + s, "bpm"])
        for m, name, value in ((1, "SBP", 120), (3, "DBP", 70), (5, "Temperature", 98.6), (7, "O2 Saturation", 97), (9, "FiO2", 40), (11, "HR", 5000), (13, "HR", "")):
            chart.append([100 + s, 1000 + s, at(m), ITEMS[name], "" if value == "" else value, value, ""])
        labs += [[100 + s, ITEMS["Lactate"], at(15), "2.0", 2.0, "mmol/L"], [100 + s, ITEMS["Lactate"], at(900), "9", 9.0, ""], [100 + s, ITEMS["Lactate"], at(16), "", "", ""]]
        given += [[1000 + s, ITEMS["Furosemide"], at(0), at(150), 5.0, "mg", 80.5], [1000 + s, ITEMS["Furosemide"], at(4), at(5), 9000, "mg", 80.5]]
        outs += [[1000 + s, 226559, at(20), 300, "mL"], [1000 + s, 226559, at(21), 99999, "mL"]]
    write(folder, "icustays", ["subject_id", "hadm_id", "stay_id", "intime", "outtime", "first_careunit", "los"], stays)
    write(folder, "patients", ["subject_id", "gender", "anchor_age", "anchor_year", "dod"], patients)
    write(folder, "chartevents", ["hadm_id", "stay_id", "charttime", "itemid", "value", "valuenum", "valueuom"], chart)
    write(folder, "labevents", ["hadm_id", "itemid", "charttime", "value", "valuenum", "valueuom"], labs)
    write(folder, "outputevents", ["stay_id", "itemid", "charttime", "value", "valueuom"], outs)
    write(folder, "d_items", ["itemid", "label", "abbreviation", "unitname", "param_type"], [[226559, "Foley", "Foley", "mL", ""], [1, "", "", "", ""]])
    write(folder, "inputevents", ["stay_id", "itemid", "starttime", "endtime", "amount", "amountuom", "patientweight"], given)
    return folder


@pytest.fixture(scope="module")
def built(spark, raw, tmp_path_factory):
    items = spark.createDataFrame(list(ITEMS.items()), "feature string, itemid long")
    return hospital.build(spark, raw, items, str(tmp_path_factory.mktemp("out")), seed=2026)


def test_events(built):
    assert built["stays"].count() == 7  # a minor is left out
    got = {(r["name"], r["minute"]): r["n"] for r in built["events"].groupBy("name", F.lit(0).alias("minute")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[("HR", 0)] == 7 * 45 and got[("Temperature", 0)] == 7 and got[("Lactate", 0)] == 14 and got[("Urine", 0)] == 14
    assert got[("Furosemide", 0)] == 7 * 4 and got[("Weight", 0)] == 14
    one = built["events"].filter("stay_id = 1001")
    assert {r["valuenum"] for r in one.filter("name = 'Urine'").collect()} == {300.0}
    assert sorted(round(r["valuenum"], 9) for r in one.filter("name = 'Furosemide'").collect()) == [1.0, 2.0, 2.0, 2.0]
    assert one.filter("name = 'FiO2'").first()["valuenum"] == pytest.approx(0.4)


def test_minutes_and_samples(built):
    one = {(r["minute"], r["variable"]): r["value"] for r in built["minutes"].filter("stay_id = 1001").collect()}
    assert one[(0, "HR")] == 61 and one[(15, "Lactate")] == 2.0 and (900, "Lactate") not in one and one[(5, "Temperature")] == pytest.approx(37)
    rows = built["rows"].filter("stay_id = 1001").collect()
    assert {r["k"] for r in rows} == {0} and sum(r["is_target"] for r in rows) == 5 and max(r["minute"] for r in rows) < 40


def test_split_and_scores(built):
    assert built["split"].count() == 7
    history = built["scaled"].filter("is_target = 0 and split <> 'test' and variable = 'HR'")
    mean, std = history.agg(F.avg("value"), F.stddev_pop("value")).first()
    assert mean == pytest.approx(0, abs=1e-9) and std == pytest.approx(1)
    assert built["triplets"].groupBy("stay_id").count().agg(F.max("count")).first()[0] <= 60


def test_forecasts(built):
    got = hospital.evaluate(built, EmpiricalForecaster(1), draws=20).first()
    assert got["mse"] > 0 and got["crps"] > 0 and got["n_observations"] > 0
    zero = DiffusionForecaster(lambda x, t, rows: x * 0, seed=3, steps=5)
    made = zero.forecast(built["scaled"].filter("split = 'test'"), 4).collect()
    assert made and all(len(r["draws"]) == 4 for r in made)
    assert [tuple(r) for r in made] == [tuple(r) for r in zero.forecast(built["scaled"].filter("split = 'test'"), 4).collect()]


def test_schedule():
    beta = schedule(50)
    assert len(beta) == 50 and beta[0] == pytest.approx(0.0001) and beta[-1] == pytest.approx(0.5)


def test_csv_types(spark, tmp_path):
    write(str(tmp_path), "chartevents", ["ITEMID", "value", "valuenum", "charttime", "stay_id", "hadm_id", "valueuom", "more"], [["7.0", "NaN", "NA", at(0), "", "x", "bpm", "y"]])
    row = tables.read_hospital(spark, str(tmp_path), "chartevents").first()
    assert tables.read_hospital(spark, str(tmp_path), "chartevents").schema == INPUTS["chartevents"]
    assert (row["itemid"], row["value"], row["valuenum"], row["stay_id"], row["hadm_id"], row["valueuom"]) == (7, None, None, None, None, "bpm")


def test_reports(spark, tmp_path):
    p = spark.createDataFrame([(2, "HR", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, "HR", 2.0, 1.0, 1.0, 1.0, 1.0, 1.0)], tables.PREDICTIONS)
    tables.write_predictions(p.select(*reversed(p.columns)), str(tmp_path / "p"), single=True)
    (part,) = [f for f in os.listdir(tmp_path / "p") if f.endswith(".csv")]
    lines = (tmp_path / "p" / part).read_text().splitlines()
    assert lines[0].startswith("sample_id,signal,minute,actual,") and lines[1].startswith("1,")
    tables.write_json(tables.metrics_json(spark.createDataFrame([(0.5,)], "crps double"), spark.createDataFrame([("HR", 1.0), ("DBP", None)], "signal string, mse double")), str(tmp_path / "j"))
    (part,) = [f for f in os.listdir(tmp_path / "j") if f.endswith(".json")]
    assert [s["signal"] for s in json.loads((tmp_path / "j" / part).read_text())["per_signal"]] == ["DBP", "HR"]
    assert tables.plot_data(spark.createDataFrame([(1, float(i)) for i in range(9)], "id int, draw double"), ["id"]).first()["quartiles"] == [2.0, 4.0, 6.0]


def test_config_and_metadata(spark, tmp_path):
    config = tables.Config.from_dict({"seed": 3, "train": {"epochs": 5}, "diffusion": {"steps": 10}})
    assert config.train.epochs == 5 and config.diffusion.steps == 10 and config.x_size == 60
    tables.write_metadata(spark, str(tmp_path / "m.json"), config.metadata(split_seed=3))
    assert tables.read_metadata(spark, str(tmp_path / "m.json"))["split_seed"] == 3 and tables.read_metadata(spark, str(tmp_path / "none.json")) is None
    with pytest.raises(ValueError):
        tables.Config(seed=-1)
    tables.write_artifact(spark, f"file:{tmp_path}/save/model.bin", b"x\x00")
    for given in (f"{tmp_path}/save", f"{tmp_path}/save/model.bin"):
        assert tables.find_artifact(spark, given) == (f"{tmp_path}/save/model.bin", b"x\x00")
    assert tables.find_artifact(spark, "save", root=str(tmp_path))[1] == b"x\x00"
    with pytest.raises(FileNotFoundError):
        tables.find_artifact(spark, str(tmp_path / "other"))


def test_streams(spark, tmp_path):
    data = [(1, "HR", float(v), START + dt.timedelta(seconds=30 * v)) for v in range(60)] + [(1, "HR", math.nan, START)]
    df = spark.createDataFrame(data, "stay_id long, variable string, value double, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, frame in (("m", stream.minute_means(source)), ("w", stream.target_windows(source, ["HR"]))):
        frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("m").orderBy("minute_start").first()["value"] == 0.5
    assert spark.table("w").orderBy("target_start").first()["n"] == 21
    assert catalog.TARGETS[0] == "HR"


def test_tensors_have_their_fixed_sizes(built):
    x, y = built["inputs"].collect(), built["targets"].collect()
    assert x and all(len(r[f"x_{c}"]) == 60 for r in x for c in ("vind", "minute", "value", "mask")) and all(len(r["y_mask"]) == 50 for r in y)
    chosen = {r["stay_id"]: r["count"] for r in built["triplets"].groupBy("stay_id").count().collect()}
    assert {r["stay_id"]: sum(r["x_mask"]) for r in x} == chosen
    last = built["variables"].count()
    assert all(v == last and m == -1 for r in y for v, m, k in zip(r["y_vind"], r["y_minute"], r["y_mask"]) if not k)


def test_command_line(spark, raw, tmp_path):
    items, out, config = tmp_path / "items.csv", f"file:{tmp_path}/out", tmp_path / "run.yaml"
    items.write_text("feature,itemid\n" + "\n".join(f"{k},{v}" for k, v in ITEMS.items()) + "\n")
    config.write_text("seed: 2026  # of all\ntrain:\n  epochs: 2\n  batch_size: 4\n  rate: 1e-2\ndiffusion:\n  steps: 3\n  channels: 8\n  heads: 2\n  layers: 1\n")
    common = ["--config", str(config)]
    cli.run([*common, "build", raw, "--items", str(items), "--out", out], spark)
    model = f"file:{tmp_path}/model"
    cli.run([*common, "train", "--out", out, "--model-folder", model, "--nsample", "3"], spark)
    assert len(tables.read_metadata(spark, f"{model}/run.json")["losses"]) == 2
    cli.run(["infer", "--out", out, "--checkpoint", model, "--nsample", "4", "--n-examples", "1", "--output-dir", str(tmp_path / "infer")], spark)
    made = spark.read.parquet(str(tmp_path / "infer" / "draws"))
    assert made.count() and all(len(r["draws"]) == 4 for r in made.collect())
    predicted = spark.read.option("header", True).csv(str(tmp_path / "infer" / "predictions"))
    assert predicted.columns == [f.name for f in tables.PREDICTIONS] and predicted.count() == made.count()
    assert 40 < float(predicted.filter("signal = 'HR'").first()["actual"]) < 200  # clinical units
    nested = spark.read.json(str(tmp_path / "infer" / "metrics")).first()
    assert {s["label"] for s in nested["per_signal"]} >= {"HR (bpm)", "SpO₂ (%)"} and nested["crps"] is not None
    with pytest.raises(ValueError):
        cli.run([*common, "infer", "--out", out, "--checkpoint", model, "--data-seed", "7"], spark)
    with pytest.warns(UserWarning):
        assert not split.check_seed_file(spark, str(tmp_path / "none.json"), 1)


def test_item_tables(spark, tmp_path):
    (tmp_path / "items.csv").write_text("itemid,feature,more\n211,HR,x\n220045,HR,\n")
    assert sorted(map(tuple, tables.read_items(spark, str(tmp_path / "items.csv")).collect())) == [("HR", 211), ("HR", 220045)]


def test_run_goes_on_where_it_broke_off(spark, raw, built, tmp_path, monkeypatch):
    items, out = spark.createDataFrame(list(ITEMS.items()), "feature string, itemid long"), f"file:{tmp_path}/out"
    real, made = hospital.minute_table, []
    monkeypatch.setattr(hospital, "minute_table", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        hospital.build(spark, raw, items, out)
    with pytest.raises(FileNotFoundError):
        hospital.stored(spark, out)
    monkeypatch.setattr(hospital, "minute_table", lambda *a: made.append("minutes") or real(*a))
    for name in ("adult_stays", "clean_events"):
        monkeypatch.setattr(hospital, name, lambda *a, name=name: made.append(name))
    got = hospital.build(spark, raw, items, out)
    assert made == ["minutes"]  # what was finished isn't made again
    for name in hospital.TABLES:
        columns = sorted(built[name].columns)
        assert sorted(map(str, got[name].select(columns).collect())) == sorted(map(str, built[name].select(columns).collect()))
    counts = hospital.stage_counts(spark, out)
    events = got["events"]
    assert counts["events"]["rows"] == events.count() and counts["events"]["from_lab"] == events.filter("source = 'lab'").count() > 0
    assert counts["rows"]["history"] + counts["rows"]["target"] == got["rows"].count() and counts["events"]["dropped_but_no_number"] == 0
    monkeypatch.undo()
    before = hospital.stored(spark, out)["minutes"].inputFiles()
    again = hospital.build(spark, raw, items, out)
    assert not set(again["minutes"].inputFiles()) & set(before) and all(os.path.exists(f.removeprefix("file://")) for f in before)


def test_a_dropped_feature_without_a_number_fails_its_stage(spark, raw, tmp_path, monkeypatch):
    items = spark.createDataFrame(list(ITEMS.items()), "feature string, itemid long")
    real = hospital.clean_events
    monkeypatch.setattr(hospital, "clean_events", lambda *a: real(*a).withColumn("valuenum", F.when(F.col("valuenum") != 61, F.col("valuenum"))))
    with pytest.raises(StageError, match="dropped_but_no_number"):
        hospital.build(spark, raw, items, str(tmp_path))


def test_draws_follow_the_given_betas(spark, built):
    rows = built["scaled"].filter("split = 'test'")
    seen = []
    own = schedule(4, 0.001, 0.1)
    for beta in (None, own):
        f = DiffusionForecaster(lambda x, t, rows: x * 0, seed=3, steps=4, beta=beta)
        seen.append([r["draws"] for r in f.forecast(rows, 2).collect()])
        assert len(f.beta) == 4
    assert seen[0] and seen[0] != seen[1]


def test_x_size_of_the_settings(spark, raw, tmp_path):
    items = spark.createDataFrame(list(ITEMS.items()), "feature string, itemid long")
    made = hospital.build(spark, raw, items, str(tmp_path), x_size=9)
    assert all(len(r["x_value"]) == 9 for r in made["inputs"].collect()) and made["triplets"].groupBy("stay_id").count().filter("count > 9").isEmpty()


def test_predictions_in_parts(spark, tmp_path):
    p = spark.createDataFrame([(i, "HR", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(40)], tables.PREDICTIONS).repartition(5)
    tables.write_predictions(p, str(tmp_path / "p"))
    lines = []
    for f in sorted(os.listdir(tmp_path / "p")):
        if f.endswith(".csv"):
            lines += [int(line.split(",")[0]) for line in (tmp_path / "p" / f).read_text().splitlines()[1:]]
    assert lines == list(range(40))


def test_plot_data_does_not_depend_on_row_order(spark):
    draws = spark.createDataFrame([(1, float(i % 7)) for i in range(50)] + [(2, 3.0)] * 4 + [(1, None), (1, math.nan)], "id int, draw double")
    a, b = ({r["id"]: r for r in tables.plot_data(d, ["id"], 7).collect()} for d in (draws, draws.orderBy(F.rand(3)).repartition(3)))
    assert a == b and [h["count"] for h in a[1]["histogram"]] == [8] + [7] * 6 and a[2]["histogram"][0]["count"] == 4
