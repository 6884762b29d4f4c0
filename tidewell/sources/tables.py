"""Readers and writers: CSV with declared types, stage tables, run metadata, reports and model artifacts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import expressions as X
from tidewell.functions.schemas import INPUTS, PREDICTIONS, struct
from tidewell.operators.numbering import file_places
from tidewell.sources.stages import existing


def read_csv(spark: SparkSession, path: str, schema: T.StructType, place: str | None = None) -> DataFrame:
    """The schema's columns of a CSV file with a header, whatever others it has and in what order.

    Columns are matched by name, values that don't parse become null, and the texts NA and NaN count as missing. Large
    files are split over tasks. With place, a column of that name tells each row's place in the file.
    """
    names = spark.read.option("header", True).csv(path).columns
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    by_name = {n.lower(): n for n in names}
    if place:
        raw = file_places(raw, place)
    typed = [X.parsed(F.col(f"`{by_name[f.name]}`"), f.dataType.simpleString()).alias(f.name) for f in schema]
    return raw.select(*typed, *([place] if place else []))


def read_hospital(spark: SparkSession, folder: str, name: str, place: str | None = None) -> DataFrame:
    """One of the hospital's raw tables, from its CSV file below the folder; see read_csv."""
    where = {"icustays": "icu", "chartevents": "icu", "outputevents": "icu", "d_items": "icu", "inputevents": "icu"}.get(name, "hosp")
    return read_csv(spark, f"{folder}/{where}/{name}.csv*", INPUTS[name], place)


def write_table(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """A stage's table as Parquet, and the table as read again."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_predictions(df: DataFrame, path: str, single: bool = False) -> None:
    """Prediction rows in their fixed column order as CSV, ordered over the files by name; one file on request, for few rows."""
    columns, order = [f.name for f in PREDICTIONS], ["sample_id", "signal", "minute"]
    rows = df.select(*columns)
    rows = rows.orderBy(*order).coalesce(1) if single else rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("header", True).csv(path)


def metrics_json(metrics: DataFrame, by_signal: DataFrame) -> DataFrame:
    """One row: the run's metrics with those of each signal nested."""
    nested = by_signal.agg(F.sort_array(F.collect_list(F.struct("signal", *[c for c in by_signal.columns if c != "signal"]))).alias("per_signal"))
    return metrics.crossJoin(nested)  # one row each


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


@dataclass
class TrainConfig:
    epochs: int = 200
    batch_size: int = 32
    rate: float = 0.001
    patience: int = 3


@dataclass
class DiffusionConfig:
    steps: int = 50
    beta_start: float = 0.0001
    beta_end: float = 0.5
    layers: int = 3
    channels: int = 128
    heads: int = 8


@dataclass
class Config:
    """Settings of a run; from_dict takes nested dicts as JSON or YAML readers give them."""

    seed: int = 2026
    x_size: int = 60
    train: TrainConfig = field(default_factory=TrainConfig)
    diffusion: DiffusionConfig = field(default_factory=DiffusionConfig)

    def __post_init__(self):
        if self.seed < 0:
            raise ValueError("the seed is 0 or more")

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        kinds = {"train": TrainConfig, "diffusion": DiffusionConfig}
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__}
        return cls(**{k: kinds[k](**v) if k in kinds else v for k, v in known.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        """Settings of a JSON file, or of a YAML file with scalars in one level of blocks."""
        text = spark.read.text(path, wholetext=True).first()["value"]
        return cls.from_dict(json.loads(text) if text.lstrip().startswith("{") else read_blocks(text))

    def metadata(self, **more) -> dict:
        return {"seed": self.seed, "config": asdict(self), **more}


def read_blocks(text: str) -> dict:
    """The scalars of a YAML text: `key: value` lines, and blocks of indented ones below `key:`."""
    out: dict = {}
    block = out
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare or bare.lstrip().startswith("#") or bare == "---":
            continue
        key, colon, value = (part.strip() for part in bare.partition(":"))
        if not colon:
            raise ValueError(f"not a setting: {line!r}")
        block = block if line[0] in " \t" else out
        if not value:
            block = out[key] = {}
            continue
        try:
            block[key] = json.loads(value)
        except json.JSONDecodeError:
            try:
                block[key] = float(value)
            except ValueError:
                block[key] = value.strip("'\"")
    return out


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """feature and itemid, from a CSV file with these columns."""
    return read_csv(spark, path, struct("feature string, itemid long"))


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    """Run metadata as a JSON text, at any path that Spark can write."""
    text = json.dumps(metadata, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict | None:
    """Stored run metadata; None where there is none."""
    found = existing(spark, path, "text")
    lines = found.coalesce(1).collect() if found is not None else []
    return json.loads("\n".join(r["value"] for r in lines)) if lines else None


def write_artifact(spark: SparkSession, path: str, content: bytes) -> None:
    """A model's bytes, at any path that Spark can write."""
    spark.createDataFrame([(bytearray(content),)], "content binary").coalesce(1).write.mode("overwrite").parquet(path)


def find_artifact(spark: SparkSession, given: str, name: str = "model.bin", root: str = "save") -> tuple[str, bytes]:
    """Path and bytes of the first that exists of: the artifact itself, name in the folder, name in root/given; an error if none does."""
    tried = [given, f"{given}/{name}", f"{root}/{given}/{name}"]
    for path in tried:
        found = existing(spark, path, "parquet", "content binary")
        rows = found.filter("content IS NOT NULL").head(1) if found is not None else []
        if rows:
            return path, bytes(rows[0]["content"])
    raise FileNotFoundError(f"no model at {', '.join(tried)}")


def plot_data(draws: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """What a distribution plot shows of each key's draws: a histogram of `bins` equal bins from least to greatest, and quartiles.

    The histogram is an array of (from, count); draws that are all equal fill the first bin. Missing draws don't count.
    """
    seen = draws.filter(F.col("draw").isNotNull() & ~F.isnan("draw"))
    q = F.percentile(F.col("draw"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles")
    around = seen.groupBy(*keys).agg(F.min("draw").alias("_low"), F.max("draw").alias("_high"), q)
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(bins - 1), F.floor((F.col("draw") - F.col("_low")) / width))).otherwise(0).cast("int")
    ends = ["_low", "_high", "quartiles"]
    counted = seen.join(around, keys).groupBy(*keys, *ends, place.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    found = counted.groupBy(*keys, *ends).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_by_bin"))  # `bins` entries
    start = lambda i: F.col("_low") + i * (F.col("_high") - F.col("_low")) / bins
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(start(i).alias("from"), F.coalesce(F.try_element_at("_by_bin", i), F.lit(0)).alias("count")))
    return found.select(*keys, each.alias("histogram"), "quartiles")
