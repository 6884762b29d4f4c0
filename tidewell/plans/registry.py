"""Registered queries: every operator of the engine over the driver's tables.

The hospital's shape is found in them as follows: a subject is a customer, a stay is an order or a user of the event stream,
a charted event is an event, a laboratory result is a line item, an item's label is a part's name, forecast draws are the
components of an embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import catalog, expressions as X
from tidewell.operators import align, extract, forecast, metrics, normalise, split, triplets, windows
from tidewell.operators.joins import small
from tidewell.operators.numbering import hash_rank, row_chunks as row_blocks, shuffled_batches as batches_of
from tidewell.sources.tables import plot_data

TARGETS = ["click", "view", "error"]
SEED = 2026

# Fixed values of these queries: feature, remainder of the item key modulo 8 (a key can feed several), bounds, unit scale.
RULES = [("alpha", 0, 5.0, 90.0), ("beta", 1, 0.0, 40.0), ("beta", 2, 0.0, 40.0), ("gamma", 2, 10.0, 60.0), ("delta", 5, 0.0, 20.0), ("delta", 7, 0.0, 20.0)]
KEYWORDS = {"metal": ["bolt", "gear"], "small": ["small", "gizmo"], "warm": ["red", "hot "]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the engine's columns; the item identifier is the key in props."""
    raw = load(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("long")
    return raw.select("event_id", F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"), F.col("event_type").alias("variable"), "value", item.alias("itemid"))


def hourly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each stay, hour since its first event and variable; the hour stands in for the minute."""
    at = align.dealt_minutes(events(spark, sf_dir).select("stay_id", "charttime", "variable", "value"), "stay_id", "charttime")
    at = at.withColumn("minute", F.floor(F.col("minute") / 60).cast("long"))
    return align.minute_means(align.distinct_events(at, "stay_id", "minute", "variable", "value"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def scan_project(spark, d):
    return events(spark, d).select("event_id", "stay_id", "charttime", F.col("value").alias("valuenum"), F.upper("variable").alias("name"))


def filter_not_both_null(spark, d):
    e = events(spark, d).select("event_id", F.nullif("variable", F.lit("error")).alias("text"), F.when(F.col("value") > 20, F.col("value")).alias("number"))
    return extract.not_both_null(e, "text", "number")


def adult_filter_age(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer").filter("c_nationkey < 20")
    stays = o.select(F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("intime"))
    patients = c.select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 40).cast("int").alias("anchor_age"), F.lit(1994).alias("anchor_year"))
    return extract.adults(stays, patients).select("stay_id", "subject_id", F.col("age").cast("long").alias("age"))


def semi_join_stays(spark, d):
    keys = load(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("stay_id"))
    return extract.of_keys(events(spark, d), keys, "stay_id").select("event_id", "stay_id")


def rule_join_drop(spark, d):
    rules = spark.createDataFrame(RULES, "feature string, part long, low double, high double")
    joined = events(spark, d).withColumn("part", F.col("itemid") % 8).join(F.broadcast(rules), "part")  # six rows
    return joined.filter(X.in_range(F.col("value"), F.col("low"), F.col("high"))).select("event_id", "feature", "value")


def unit_convert(spark, d):
    e = events(spark, d).withColumn("unit", F.when(F.col("variable") == "click", "mcg").when(F.col("variable") == "view", "L").otherwise("F"))
    value, unit = X.to_milligrams(F.col("value"), F.col("unit"))
    celsius = F.when(unit == "F", (value - 32) * 5 / 9).otherwise(value)
    return rounded(e.select("event_id", celsius.alias("value"), unit.alias("unit"), X.fraction(F.col("value")).alias("fraction")), "value", "fraction")


def recode_text(spark, d):
    e = events(spark, d).select("event_id", F.nullif("variable", F.lit("view")).alias("text"), "value")
    e = e.filter(~F.col("text").eqNullSafe("error"))
    return e.select("event_id", X.recode(F.col("text"), F.col("value"), ["click"], ["purchase"]).alias("value"))


def label_keyword_match(spark, d):
    items = load(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    return extract.label_items(items, KEYWORDS)


def binarize(spark, d):
    e = events(spark, d).withColumn("less", F.col("value") - 30)
    return e.select("event_id", X.binary(F.col("less")).alias("flag"))


def conditional_median_impute(spark, d):
    filled = extract.impute_median(events(spark, d).select("event_id", "variable", "value"), "variable", "value", X.in_range(F.col("value"), 5, 60))
    return rounded(filled.select("event_id", "variable", "value"), "value")


def intervals(spark, d):
    raw = events(spark, d).withColumns({"starttime": F.col("charttime"), "amount": F.col("value")})
    seconds = F.floor(F.col("value") * 60).cast("long")
    return raw.withColumn("endtime", F.timestamp_add("SECOND", seconds, F.col("charttime"))).select("event_id", "starttime", "endtime", "amount")


def hourly_interval_split(spark, d):
    return rounded(extract.split_hourly(intervals(spark, d)).select("event_id", "charttime", "amount"), "amount")


def interval_assign_first(spark, d):
    o, i = load(spark, d, "orders"), load(spark, d, "lineitem")
    span = F.expr("INTERVAL '60' DAY")
    stays = o.select(F.col("o_custkey").alias("hadm_id"), F.col("o_orderkey").alias("stay_id"), F.col("o_orderdate").alias("intime"), (F.col("o_orderdate") + span).alias("outtime"), F.col("o_orderkey").alias("stay_ord"))
    labs = i.select(F.col("l_partkey").alias("hadm_id"), F.col("l_shipdate").alias("charttime"), "l_orderkey", "l_linenumber").distinct()
    return align.assign_stay(labs, stays).select("l_orderkey", "l_linenumber", "hadm_id", "charttime", "stay_id")


def relative_minute(spark, d):
    return align.minutes_since_first(events(spark, d), "stay_id", "charttime").select("event_id", "stay_id", "minute")


def dedupe_events(spark, d):
    e = events(spark, d).withColumn("value", F.floor(F.col("value") / 10))
    return align.distinct_events(e, "stay_id", "variable", "value")


def minute_aggregate(spark, d):
    timed = align.minutes_since_first(events(spark, d), "stay_id", "charttime").filter(X.in_range(F.col("value"), 0, 390))
    means = align.minute_means(align.distinct_events(timed, "stay_id", "minute", "variable", "value"), firsts=())
    return rounded(means, "value")


def list_intervals(spark, d):
    o = load(spark, d, "orders")
    lists = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("s"))
    return lists.select("o_custkey", F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: x["o_orderkey"].cast("string")), ",").alias("stays"))


def dense_index(spark, d):
    e = events(spark, d)
    index = align.variable_index(e.select(F.col("variable").alias("name")), TARGETS)
    stays = align.stay_index(e.select("stay_id").distinct(), "stay_id")
    named = e.join(index.withColumnRenamed("name", "variable"), "variable").join(stays, "stay_id")
    return named.select("event_id", F.col("vind").cast("long").alias("vind"), F.col("ts_ind").cast("long").alias("ts_ind"), "is_target")


def union_sources(spark, d):
    chart = events(spark, d).filter("variable = 'click'").select("event_id", "value", F.lit("chart").alias("source"))
    lab = events(spark, d).filter("variable = 'view'").select("event_id", "itemid", F.lit("lab").alias("source"))
    return chart.unionByName(lab, allowMissingColumns=True).select("event_id", "value", F.coalesce("itemid", F.lit(-1)).alias("itemid"), "source")


def static_side_rows(spark, d):
    c = load(spark, d, "customer")
    stays = c.select(F.col("c_custkey").alias("stay_id"), (F.col("c_custkey") % 90).alias("age"), F.when(F.col("c_nationkey") % 3 == 0, "M").when(F.col("c_nationkey") % 3 == 1, "F").alias("gender"))
    return align.statics(stays).filter(~F.col("variable").isin("Height")).select("stay_id", "minute", "variable", "value")


def stay_max_minute(spark, d):
    return windows.last_minute(hourly_table(spark, d))


def window_candidates(spark, d):
    return windows.window_candidates(hourly_table(spark, d), TARGETS)


def first_window(spark, d):
    return windows.first_windows(hourly_table(spark, d), TARGETS)


def sample_table(spark, d):
    return windows.first_window_rows(hourly_table(spark, d), TARGETS)


def window_samples(spark, d):
    return rounded(sample_table(spark, d), "value").select("stay_id", "k", "minute", "variable", "value", F.col("is_target").cast("long").alias("is_target"))


def variables(spark, d):
    """vind of each variable; a few rows, so that samples stay where they are when they get it."""
    index = align.variable_index(events(spark, d).select(F.col("variable").alias("name")), TARGETS)
    return small(index.select("vind", F.col("name").alias("variable")))


def sample_lengths(spark, d):
    made = windows.samples(sample_table(spark, d).join(variables(spark, d), "variable"))
    return made.select("stay_id", F.col("t0").cast("long").alias("t0"), F.col("x_len").cast("long").alias("x_len"), F.col("y_len").cast("long").alias("y_len"), F.size("events").cast("long").alias("n"))


def subjects(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"))


def patient_split(spark, d):
    return split.split_subjects(subjects(spark, d), SEED).select("subject_id", F.col("place").cast("long").alias("place"), "split")


def fitted(spark, d):
    parts = split.split_subjects(events(spark, d).select(F.col("stay_id").alias("subject_id")), SEED).filter("split <> 'test'")
    history = sample_table(spark, d).filter("is_target = 0").join(parts.select(F.col("subject_id").alias("stay_id")), "stay_id", "left_semi")
    return normalise.fit_stats(history, events(spark, d).select("variable"))


def norm_stats(spark, d):
    return rounded(fitted(spark, d), "mean", "std")


def zscore(spark, d):
    return rounded(normalise.scale(sample_table(spark, d), fitted(spark, d)).select("stay_id", "minute", "variable", "value"), "value")


def unscale_roundtrip(spark, d):
    stats = fitted(spark, d)
    return rounded(normalise.unscale(normalise.scale(sample_table(spark, d), stats), stats).select("stay_id", "minute", "variable", "value"), "value", places=4)


def history_rows(spark, d):
    rows = sample_table(spark, d).filter("is_target = 0").join(variables(spark, d), "variable")
    pos = F.row_number().over(Window.partitionBy("stay_id").orderBy("minute", "vind")) - 1
    return rows.select("stay_id", pos.alias("pos"), "vind", "minute", "value")


def last_n_per_target(spark, d):
    # variables in byte order: click 0, error 1, purchase 2, signup 3, view 4
    kept = triplets.recent_rows(history_rows(spark, d), "stay_id", [0, 1, 4], [2], size=8)
    return rounded(kept.select("stay_id", F.col("pos").cast("long").alias("pos"), F.col("vind").cast("long").alias("vind"), "minute", "value"), "value")


def pad_triplets(spark, d):
    grouped = history_rows(spark, d).filter("pos < 60").groupBy("stay_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value", "minute"))).alias("s"))
    size = triplets.X_SIZE
    values = triplets.padded(F.transform("s", lambda x: x["value"]), size, 0.0)
    minute = triplets.padded(F.transform("s", lambda x: x["minute"].cast("double")), size, float(triplets.PAD_MINUTE))
    mask = triplets.padded(F.transform("s", lambda x: F.lit(1.0)), size, 0.0)
    zipped = grouped.select("stay_id", F.posexplode(F.arrays_zip(values.alias("value"), minute.alias("minute"), mask.alias("mask"))))
    out = zipped.select("stay_id", F.col("pos").cast("long").alias("pos"), F.col("col")["value"].alias("value"), F.col("col")["minute"].alias("minute"), F.col("col")["mask"].alias("mask"))
    return rounded(out, "value")


def balanced_triplets(spark, d):
    made = triplets.balanced(history_rows(spark, d), "stay_id", [0, 1, 4], [2], size=12, seed=SEED)
    return rounded(made.withColumns({c: F.col(c).cast("long") for c in ("pos", "vind", "slot")}), "value")


def history_arrays(spark, d):
    """Histories as fixed arrays: the chosen events, padded."""
    chosen = triplets.balanced(history_rows(spark, d), "stay_id", [0, 1, 4], [2], size=12, seed=SEED)
    names = ["vind", "minute", "value", "mask"]
    arrays = triplets.fixed_arrays(chosen, "stay_id", 12, "x", 5)
    zipped = arrays.select("stay_id", F.posexplode(F.arrays_zip(*(F.col(f"x_{n}").alias(n) for n in names))))
    return rounded(zipped.select("stay_id", F.col("pos").cast("long").alias("pos"), *(F.col("col")[n].alias(n) for n in names)), "value")


def draw_rows(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("draws"))
    return e.withColumn("actual", F.col("draws")[0].cast("double"))


def forecast_summary(spark, d):
    out = metrics.array_summary(draw_rows(spark, d), ["vec_id", "label", "actual"])
    return rounded(out, "actual", "predicted_median", "predicted_mean", "predicted_p025", "predicted_p975")


def masked_mse(spark, d):
    means = metrics.array_means(draw_rows(spark, d), ["vec_id", "label", "actual"])
    means = means.withColumn("mask", F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(1.0))
    return rounded(metrics.masked_mse(means, ["label"]), "mse")


def signal_mse(spark, d):
    rows = metrics.array_summary(draw_rows(spark, d), ["vec_id", "label", "actual"])
    rows = rows.select(F.col("label").alias("signal"), "actual", F.col("predicted_median").alias("median"), F.col("predicted_mean").alias("mean"), (F.col("label") * 0.5).cast("double").alias("std"))
    signals = spark.range(0, 12).select(F.col("id").alias("signal"))
    names = [f"mse_{c}_{s}" for c in ("median", "mean") for s in ("standardized", "original")]
    return rounded(metrics.mse_by_signal(rows, signals), *names)


def quantile_crps(spark, d):
    q = metrics.array_quantiles(draw_rows(spark, d), ["vec_id", "label", "actual"], metrics.TEST_LEVELS).withColumn("mask", F.lit(1.0))
    return rounded(metrics.quantile_crps(q, ["label"]), "crps")


def cumprod_schedule(spark, d):
    table = forecast.schedule_table(spark).withColumn("step", F.col("step").cast("long"))
    at = load(spark, d, "embeddings").groupBy((F.col("vec_id") % 50).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(at.join(F.broadcast(table), "step").select("step", "beta", "alpha", "n"), "beta", "alpha", places=9)  # 50 rows


def forward_noise(spark, d):
    table = forecast.schedule_table(spark).select(F.col("step").cast("long").alias("step"), "alpha")
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("value"), F.col("embedding")[1].cast("double").alias("noise"), (F.col("vec_id") % 50).alias("step"))
    joined = e.join(F.broadcast(table), "step")  # 50 rows
    return rounded(joined.select("vec_id", "step", forecast.noised(F.col("value"), F.col("noise"), F.col("alpha"), F.lit(1.0)).alias("noised")), "noised")


def topk_examples(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def seeded_shuffle(spark, d):
    digest = F.md5(F.concat(F.lit("2026:1:"), F.col("subject_id").cast("string")))
    return hash_rank(subjects(spark, d), digest, "subject_id").select("subject_id", "place")


def metrics_json_struct(spark, d):
    by = signal_mse(spark, d).select("signal", "n_observations", "mse_mean_standardized")
    nested = by.agg(F.sort_array(F.collect_list(F.struct("signal", "n_observations", "mse_mean_standardized"))).alias("per_signal"), F.count(F.lit(1)).alias("signals"))
    return nested.select("signals", F.inline("per_signal"))


def empirical_forecast(spark, d):
    rows = sample_table(spark, d)
    order = Window.partitionBy("stay_id").orderBy("is_target", "minute", "variable")
    rows = rows.join(variables(spark, d), "variable").withColumn("pos", F.row_number().over(order) - 1)
    made = forecast.EmpiricalForecaster(SEED).forecast(rows, 20)
    text = F.array_join(F.transform("draws", lambda x: F.round(x, 6).cast("decimal(18,6)").cast("string")), ",")
    return rounded(made.select("stay_id", F.col("pos").cast("long").alias("pos"), F.col("vind").cast("long").alias("vind"), "minute", "actual", text.alias("draws")), "actual")


def rename_columns(spark, d):
    raw = load(spark, d, "orders").select(F.col("o_orderkey").alias("ICUSTAY_ID"), F.col("o_custkey").alias("HADM_ID"), F.col("o_totalprice").alias("Amount"))
    return extract.rename_all(raw, extract.engine_name)


def cast_columns(spark, d):
    raw = load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("text"), F.col("ts").cast("string").alias("at"))
    as_kind = lambda c, kind: X.parsed(F.col(c), kind)
    return raw.select("event_id", as_kind("k", "bigint").alias("itemid"), (as_kind("k", "double") / 2).alias("half"), as_kind("text", "double").alias("none"), as_kind("at", "timestamp_ntz").alias("at"))


#: Rules of the query drug_rules; item keys modulo 5 stand for the items.
DRUGS = [
    catalog.Rule("Furosemide", ("input",), 0.0, 40.0, "mg", catalog.MEDIAN, ("mg",), True),
    catalog.Rule("Vancomycin", ("input",), 0.0, 0.03, "g", catalog.MEDIAN, (), False, True),
    catalog.Rule("Calcium Gluconate", ("input",), 0.0, 20.0, "g", catalog.MEDIAN, ("mg", "gm"), True, True),
    catalog.Rule("Heparin", ("input",), 0.0, 30.0, "units", catalog.MEDIAN, ("gm",)),
    catalog.Rule("Sodium", ("input",), 10.0, 50.0, "mEq/L", catalog.DROP),
]


def drug_rules(spark, d):
    unit = F.when(F.col("variable") == "click", "mg").when(F.col("variable") == "error", "gm").otherwise("ml")
    amount = F.when(F.col("value") < 3, 0.0).otherwise(F.col("value"))
    raw = events(spark, d).select("event_id", (F.col("itemid") % 5).alias("itemid"), F.lit("input").alias("source"), F.lit(None).cast("string").alias("value"), amount.alias("valuenum"), unit.alias("valueuom"))
    items = spark.createDataFrame([(r.feature, i) for i, r in enumerate(DRUGS)], "feature string, itemid long")
    clean = extract.apply_rules(raw, small(catalog.item_table(items)), small(catalog.rule_table(spark, DRUGS)))
    return rounded(clean.select("event_id", "name", "valuenum", "valueuom"), "valuenum")


def item_labels(spark, d):
    raw = extract.with_values(load(spark, d, "lineitem").select(F.col("l_partkey").alias("itemid"), "l_quantity"), "l_quantity")
    items = load(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("itemid"), F.nullif("p_name", F.lit("")).alias("label"))
    return extract.item_labels(raw, items)


def number_for_text(spark, d):
    raw = events(spark, d).select("event_id", F.when(F.col("variable") == "view", F.col("variable")).otherwise(F.col("itemid").cast("string")).alias("value"))
    return extract.number_for_text(raw)


def stay_minutes(spark, d):
    e = events(spark, d)
    starts = e.groupBy("stay_id").agg(F.min("charttime").alias("intime"))
    people = load(spark, d, "customer").select(F.col("c_custkey").alias("stay_id"), F.col("c_nationkey").cast("long").alias("hadm_id"))
    stays = starts.join(people, "stay_id").select("stay_id", "hadm_id", (F.col("stay_id") * 10).alias("subject_id"), "intime")
    timed = align.with_minutes(e, stays)
    return timed.join(stays.select("stay_id", "hadm_id", "subject_id"), "stay_id").select("event_id", "minute", "hadm_id", "subject_id")


def null_counts(spark, d):
    e = events(spark, d).select(F.nullif("variable", F.lit("error")).alias("variable"), F.when(F.col("value") > 20, F.col("value")).alias("value"), "itemid")
    return extract.null_counts(e, "variable", "value", "itemid")


def required_rows(spark, d):
    kept = events(spark, d).filter(X.in_range(F.col("value"), 0, 390))
    return extract.required(kept, F.col("value").isNotNull(), "a value is missing").select("event_id", "value")


def running_mean(spark, d):
    return rounded(metrics.running_mean(events(spark, d).select("stay_id", "event_id", "value"), ["stay_id"], ["event_id"], "value").drop("value"), "running_mean", places=9)


def noise_loss(spark, d):
    e = draw_rows(spark, d).select("label", (F.col("draws")[1].cast("double") - F.col("actual")).alias("residual"), (F.col("vec_id") % 7).alias("length"))
    return rounded(metrics.noise_loss(e, ["label"], "residual", "length"), "loss")


def display_labels(spark, d):
    names = [*catalog.TARGETS, "Sodium"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    e = events(spark, d).select("event_id", name.alias("name"))
    return e.select("event_id", metrics.display_label(F.col("name"), catalog.SHOWN_NAMES, catalog.SHOWN_UNITS).alias("label"))


def prediction_rows(spark, d):
    made = draw_rows(spark, d).select("vec_id", F.concat(F.lit("s"), F.col("label")).alias("signal"), (F.col("vec_id") % 10).alias("minute"), "actual", "draws")
    stats = spark.range(10).select(F.concat(F.lit("s"), F.col("id")).alias("signal"), (F.col("id") * 3.0).alias("mean"), (F.col("id") * 0.5).alias("std"))
    out = metrics.prediction_rows(made, stats, "vec_id")
    return rounded(out, "actual", "predicted_median", "predicted_mean", "predicted_p025", "predicted_p975")


def plot_quartiles(spark, d):
    plotted = plot_data(metrics.long_draws(draw_rows(spark, d), ["vec_id", "label"]), ["vec_id", "label"])
    each = plotted.select("label", F.posexplode("quartiles").alias("i", "forecast")).withColumn("level", (F.col("i") + 1) / 4)
    return rounded(each.groupBy("label", "level").agg(F.avg("forecast").alias("forecast")), "forecast")


def row_chunks(spark, d):
    return row_blocks(load(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def shuffled_batches(spark, d):
    return batches_of(subjects(spark, d), "subject_id", SEED, 3)


def target_arrays(spark, d):
    rows = sample_table(spark, d).filter("is_target = 1").join(variables(spark, d), "variable")
    arrays = triplets.target_arrays(rows, "stay_id", len(TARGETS), 5)
    names = ["vind", "minute", "value", "mask"]
    zipped = arrays.select("stay_id", F.posexplode(F.arrays_zip(*(F.col(f"y_{n}").alias(n) for n in names))))
    return rounded(zipped.select("stay_id", F.col("pos").cast("long").alias("pos"), *(F.col("col")[n].alias(n) for n in names)), "value")


QUERIES = {
    f.__name__: f
    for f in (
        scan_project, filter_not_both_null, adult_filter_age, semi_join_stays, rule_join_drop, unit_convert, recode_text, label_keyword_match,
        binarize, conditional_median_impute, hourly_interval_split, interval_assign_first, relative_minute, dedupe_events, minute_aggregate,
        list_intervals, dense_index, union_sources, static_side_rows, stay_max_minute, window_candidates, first_window, window_samples, sample_lengths,
        patient_split, norm_stats, zscore, unscale_roundtrip, last_n_per_target, pad_triplets, balanced_triplets, history_arrays, forecast_summary, masked_mse,
        signal_mse, quantile_crps, cumprod_schedule, forward_noise, topk_examples, seeded_shuffle, metrics_json_struct, empirical_forecast,
        rename_columns, cast_columns, drug_rules, item_labels, number_for_text, stay_minutes, null_counts, required_rows, running_mean, noise_loss,
        display_labels, prediction_rows, plot_quartiles, row_chunks, shuffled_batches, target_arrays,
    )
}
