"""Writing a stage's table with counts and assertions taken in the same pass, and runs of stages that go on where they broke off."""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("tidewell.stages")


class StageError(ValueError):
    """A stage wrote rows that it must not have."""


def observed(df: DataFrame, counts: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds rows and how many of them meet each condition once df has been written."""
    watch = Observation()
    conditions = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in (counts or {}).items()]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *conditions), watch


def seen(watch: Observation) -> dict[str, int]:
    """The counts of an observation; none where Spark found the plan empty, so that it had nothing to run."""
    try:
        return {name: int(n or 0) for name, n in watch.get.items()}
    except Py4JJavaError as error:
        if "assertion failed" not in str(error):
            raise
        return {}


def write_stage(df: DataFrame, path: str, counts: dict[str, Column] | None = None, none_of: tuple[str, ...] = (), partition: tuple[str, ...] = (), dynamic: bool = False) -> dict[str, int]:
    """Write df as Parquet and return its row count and, by name, the rows that meet each condition.

    The counts are observed while the rows are written, so nothing is read twice. A condition in none_of fails the stage if a
    row met it. With dynamic only the partitions that df has are replaced. An empty df writes no partition and counts 0.
    """
    df, watch = observed(df, counts)
    writer = df.write.mode("overwrite")
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    found = {"rows": 0, **dict.fromkeys(counts or {}, 0), **seen(watch)}
    log.info("%s: wrote %s", os.path.basename(path), ", ".join(f"{n} {name}" for name, n in found.items()))
    if broken := [name for name in none_of if found[name]]:
        raise StageError("; ".join(f"{path}: {found[name]} rows with {name}" for name in broken))
    return found


MANIFEST = "run string, number long, settings string, stage string, counts string"
COMPLETE = "complete"


def existing(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame | None:
    """The table at a path; None if nothing is there."""
    try:
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass
class Run:
    """One run of stages below a folder. Every run has a folder of its own, so readers of an earlier one are left alone.

    The manifest beside the runs has a row for each finished stage with its counts, and one for a finished run.
    """

    spark: SparkSession
    folder: str
    name: str
    number: int
    settings: str
    done: dict[str, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, settings: dict) -> Run:
        """The last run if it broke off and had the same settings, else a new one."""
        text = json.dumps(settings, sort_keys=True)
        rows = cls._manifest(spark, folder)
        last = max((r["number"] for r in rows), default=-1)
        own = [r for r in rows if r["number"] == last]
        if own and own[0]["settings"] == text and all(r["stage"] != COMPLETE for r in own):
            return cls(spark, folder, own[0]["run"], last, text, {r["stage"]: json.loads(r["counts"]) for r in own})
        return cls(spark, folder, uuid.uuid4().hex, last + 1, text)

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> Run:
        """The last finished run."""
        rows = cls._manifest(spark, folder)
        ended = [r for r in rows if r["stage"] == COMPLETE]
        if not ended:
            raise FileNotFoundError(f"no finished run in {folder}")
        last = max(ended, key=lambda r: r["number"])
        done = {r["stage"]: json.loads(r["counts"]) for r in rows if r["run"] == last["run"] and r["stage"] != COMPLETE}
        return cls(spark, folder, last["run"], last["number"], last["settings"], done)

    @staticmethod
    def _manifest(spark: SparkSession, folder: str) -> list:
        found = existing(spark, f"{folder}/manifest", "json", MANIFEST)
        return found.collect() if found is not None else []  # a row for each stage and run

    def path(self, stage: str) -> str:
        return f"{self.folder}/runs/{self.name}/{stage}"

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def stage(self, name: str, make: Callable[[], DataFrame], counts: dict[str, Column] | None = None, none_of: tuple[str, ...] = ()) -> DataFrame:
        """The stage's table, made and written unless this run has it; see write_stage."""
        if name not in self.done:
            self.done[name] = write_stage(make(), self.path(name), counts, none_of)
            self._note(name, self.done[name])
        return self.read(name)

    def finish(self) -> None:
        self._note(COMPLETE, {})

    def _note(self, stage: str, counts: dict[str, int]) -> None:
        row = (self.name, self.number, self.settings, stage, json.dumps(counts, sort_keys=True))
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
