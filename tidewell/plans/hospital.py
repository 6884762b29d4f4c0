"""The whole run over a hospital's raw tables: events, minutes, samples, split, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import catalog, expressions as X
from tidewell.operators import align, extract, normalise, split, triplets, windows
from tidewell.operators.forecast import Forecaster
from tidewell.operators.joins import small
from tidewell.operators import metrics as M
from tidewell.sources.stages import Run
from tidewell.sources.tables import metrics_json, plot_data, read_hospital, write_json, write_predictions, write_table


@dataclass
class Hospital:
    """The raw tables; stays carry stay_ord, their place in the file, the order in which an admission's stays are tried."""

    stays: DataFrame
    patients: DataFrame
    chart: DataFrame
    lab: DataFrame
    output: DataFrame
    items: DataFrame
    given: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Hospital:
        names = ["patients", "chartevents", "labevents", "outputevents", "d_items", "inputevents"]
        return cls(read_hospital(spark, folder, "icustays", "stay_ord"), *(read_hospital(spark, folder, n) for n in names))


def adult_stays(h: Hospital) -> DataFrame:
    stays = extract.with_values(h.stays, "intime", "outtime", "stay_id")
    return extract.adults(stays, h.patients)


def clean_events(h: Hospital, stays: DataFrame, item_map: DataFrame) -> DataFrame:
    """All features of all sources. item_map has feature and itemid; label keywords add output items of their own."""
    spark = stays.sparkSession
    rules = catalog.rule_table(spark)
    chart = extract.of_keys(extract.not_both_null(extract.with_values(h.chart, "stay_id", "charttime"), "value", "valuenum"), stays, "stay_id")
    lab = extract.of_keys(extract.not_both_null(extract.with_values(h.lab, "hadm_id", "charttime"), "value", "valuenum"), stays, "hadm_id")
    out = extract.of_keys(extract.with_values(h.output, "stay_id", "charttime", "value"), stays, "stay_id")
    out = out.select("stay_id", "itemid", "charttime", F.lit(None).cast("string").alias("value"), F.col("value").alias("valuenum"), "valueuom")
    given = extract.of_keys(h.given, stays, "stay_id")
    hourly = extract.split_hourly(given.drop("patientweight")).select("stay_id", "itemid", "charttime", F.lit(None).cast("string").alias("value"), F.col("amount").alias("valuenum"), F.col("amountuom").alias("valueuom"))
    hourly = extract.normalise_input_units(hourly)
    parts = [d.withColumn("source", F.lit(s)) for d, s in ((chart, "chart"), (lab, "lab"), (out, "output"), (hourly, "input"))]
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part, allowMissingColumns=True)
    labels = extract.label_items(h.items.join(out.select("itemid").distinct(), "itemid", "left_semi"), catalog.KEYWORDS)
    items = catalog.item_table(item_map.select("feature", "itemid").unionByName(labels))
    clean = extract.apply_rules(events, small(items), small(rules))
    weight = given.filter(X.in_range(F.col("patientweight"), 0, 300)).select("stay_id", F.col("starttime").alias("charttime"), F.col("patientweight").alias("valuenum")).distinct()
    weight = weight.withColumns({"name": F.lit("Weight"), "valueuom": F.lit("kg")})
    return clean.unionByName(weight, allowMissingColumns=True)


def minute_table(events: DataFrame, stays: DataFrame) -> DataFrame:
    """stay_id, hadm_id, subject_id, minute, variable and value, one row for each key."""
    placed = events.filter(~F.col("source").eqNullSafe("lab"))
    placed = placed.unionByName(align.assign_stay(events.filter("source = 'lab'"), stays), allowMissingColumns=True)
    timed = align.with_minutes(placed, stays)
    named = timed.select("stay_id", "minute", F.col("name").alias("variable"), F.col("valuenum").alias("value"), "source")
    distinct = align.distinct_events(named, "stay_id", "minute", "variable", "value", "source")
    return align.minute_means(distinct).join(stays.select("stay_id", "hadm_id", "subject_id"), "stay_id")


def sample_rows(minutes: DataFrame, targets: list[str]) -> DataFrame:
    """The rows of each stay's first window, with pos, their place by part, minute and variable."""
    found = windows.first_windows(minutes, targets)
    rows = windows.window_rows(minutes, targets, found, carry=("subject_id",))
    order = Window.partitionBy("stay_id").orderBy("is_target", "minute", "variable")
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def build(spark: SparkSession, folder: str, item_map: DataFrame, out: str, seed: int = 2026, targets: list[str] | None = None, x_size: int = triplets.X_SIZE) -> dict[str, DataFrame]:
    """All stages, each written as a table of a run below `out`; the tables by name.

    A run that broke off goes on behind its last finished stage; else a new one begins, and the tables of earlier runs stay as they
    are. Every stage's rows and nulls are counted as they are written and kept in the run's manifest. A stage fails that has a row without a key,
    or a value without a number in a feature whose bad values were dropped.
    """
    targets = targets or catalog.TARGETS
    h = Hospital.read(spark, folder)
    run = Run.open(spark, out, {"folder": folder, "seed": seed, "targets": targets, "x_size": x_size})
    null = lambda *names: {f"no_{n}": F.col(n).isNull() for n in names}
    number = X.missing(F.col("valuenum"))
    dropped = F.col("name").isin([r.feature for r in catalog.rules() if r.policy == catalog.DROP])
    sources = {f"from_{s}": F.col("source").eqNullSafe(s) for s in ("chart", "lab", "output", "input")}
    t: dict[str, DataFrame] = {}
    t["stays"] = run.stage("stays", lambda: adult_stays(h), null("stay_id", "hadm_id"), ("no_stay_id",))
    counts = {**sources, **null("name"), "no_number": number, "dropped_but_no_number": number & dropped}
    t["events"] = run.stage("events", lambda: clean_events(h, t["stays"], item_map), counts, ("no_name", "dropped_but_no_number"))
    keys = null("stay_id", "minute", "variable")
    t["minutes"] = run.stage("minutes", lambda: minute_table(t["events"], t["stays"]), {**keys, "no_value": X.missing(F.col("value"))}, tuple(keys))
    names = t["minutes"].select(F.col("variable").alias("name"))
    t["variables"] = run.stage("variables", lambda: align.variable_index(names, targets, catalog.INTERVENTIONS), {"targets": F.col("is_target")})
    t["rows"] = run.stage("rows", lambda: sample_rows(t["minutes"], targets), {"history": F.col("is_target") == 0, "target": F.col("is_target") == 1})
    t["split"] = run.stage("split", lambda: split.split_subjects(t["rows"].select("subject_id"), seed), {p: F.col("split") == p for p in ("train", "valid", "test")})
    known = t["rows"].join(t["split"].filter("split <> 'test'").select("subject_id"), "subject_id", "left_semi").filter("is_target = 0")
    variables = t["variables"].select(F.col("name").alias("variable"), "vind")
    t["stats"] = run.stage("stats", lambda: normalise.fit_stats(known, variables), {"unseen": F.isnan("mean")})
    scaled = lambda: normalise.scale(t["rows"], t["stats"]).join(variables, "variable").join(t["split"].select("subject_id", "split"), "subject_id")
    t["scaled"] = run.stage("scaled", scaled, {"no_score": X.missing(F.col("value"))})
    index = {r["name"]: r["vind"] for r in t["variables"].filter("is_target or is_intervention").collect()}
    history = t["scaled"].filter("is_target = 0").select("stay_id", "pos", "vind", "minute", "value")
    wanted, given = [index[n] for n in targets], [index[n] for n in catalog.INTERVENTIONS if n in index]
    t["triplets"] = run.stage("triplets", lambda: triplets.balanced(history, "stay_id", wanted, given, x_size, seed), null("slot"), ("no_slot",))
    last = t["variables"].count()
    future = t["scaled"].filter("is_target = 1").select("stay_id", "vind", "minute", "value")
    t["inputs"] = run.stage("inputs", lambda: triplets.fixed_arrays(t["triplets"], "stay_id", x_size, "x", last))
    t["targets"] = run.stage("targets", lambda: triplets.target_arrays(future, "stay_id", len(targets), last))
    run.finish()
    return t


TABLES = ("stays", "events", "minutes", "variables", "rows", "split", "stats", "scaled", "triplets", "inputs", "targets")


def stored(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the last finished run below `out`."""
    run = Run.latest(spark, out)
    return {name: run.read(name) for name in TABLES}


def stage_counts(spark: SparkSession, out: str) -> dict[str, dict[str, int]]:
    """The counts of each stage of the last finished run."""
    return Run.latest(spark, out).done


def model_rows(tables: dict[str, DataFrame], split: str) -> DataFrame:
    """What a forecaster sees of a split's samples: the chosen history events and the target events, in standardized units."""
    own = tables["scaled"].filter(F.col("split") == split)
    columns = ["stay_id", "pos", "vind", "minute", "value"]
    history = tables["triplets"].join(own.select("stay_id").distinct(), "stay_id", "left_semi").select(*columns, F.lit(0).alias("is_target"))
    return history.unionByName(own.filter("is_target = 1").select(*columns, F.lit(1).alias("is_target")))


def draws_of(tables: dict[str, DataFrame], forecaster: Forecaster, draws: int, split: str = "test") -> DataFrame:
    """The forecaster's draws for a split: stay_id, pos, vind, minute, actual and draws."""
    if draws < 1:
        raise ValueError("at least one draw is needed")
    rows = model_rows(tables, split)
    if rows.filter("is_target = 1").isEmpty():
        raise ValueError(f"no {split} samples")
    return forecaster.forecast(rows, draws)


def scores(made: DataFrame, levels: list[float] | None = None) -> DataFrame:
    """One row with crps and mse of draws in standardized units."""
    keys = ["stay_id", "pos"]
    q = M.array_quantiles(made, [*keys, "actual"], levels or M.TEST_LEVELS).withColumn("mask", F.lit(1.0))
    crps = M.quantile_crps(q.withColumn("run", F.lit(0)), ["run"])
    mean = M.array_means(made, [*keys, "actual"]).withColumns({"mask": F.lit(1.0), "run": F.lit(0)})
    return crps.join(M.masked_mse(mean, ["run"]), "run").drop("run")  # one row each


def evaluate(tables: dict[str, DataFrame], forecaster: Forecaster, draws: int = 100, levels: list[float] | None = None, split: str = "test") -> DataFrame:
    """One row with crps and mse of a split's samples in standardized units."""
    return scores(draws_of(tables, forecaster, draws, split), levels)


def report(tables: dict[str, DataFrame], forecaster: Forecaster, out: str, draws: int = 100, examples: int = 3) -> dict[str, DataFrame]:
    """Draws, predictions, metrics by signal and plot data of the test samples, written below `out`; the tables by name."""
    names = small(tables["variables"].select("vind", F.col("name").alias("signal")))
    stats = tables["stats"].select(F.col("variable").alias("signal"), "mean", "std")
    made = write_table(draws_of(tables, forecaster, draws).join(names, "vind"), f"{out}/draws")
    t = {"draws": made, "predictions": M.prediction_rows(made, stats, "stay_id")}
    write_predictions(t["predictions"], f"{out}/predictions")
    summed = M.array_summary(made, ["stay_id", "pos", "signal", "actual"]).join(small(stats), "signal")
    by = summed.select("signal", "actual", F.col("predicted_median").alias("median"), F.col("predicted_mean").alias("mean"), "std")
    by_signal = M.mse_by_signal(by, tables["variables"].filter("is_target").select(F.col("name").alias("signal")))
    shown = M.display_label(F.col("signal"), catalog.SHOWN_NAMES, catalog.SHOWN_UNITS)
    t["by_signal"] = by_signal.withColumns({"label": shown, "unit": M.display_unit(F.col("signal"), catalog.SHOWN_UNITS)})
    t["metrics"] = write_table(scores(made), f"{out}/result")
    write_json(metrics_json(t["metrics"], t["by_signal"]), f"{out}/metrics")
    first = made.select("stay_id").distinct().orderBy("stay_id").limit(examples)
    plotted = made.join(F.broadcast(first), "stay_id", "left_semi")  # `examples` rows
    t["plots"] = write_table(plot_data(M.long_draws(plotted, ["stay_id", "signal", "pos", "minute", "actual"]), ["stay_id", "signal", "pos", "minute", "actual"]), f"{out}/plots")
    return t
