"""Helpers that the operators share: tables in the shared folder and text access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.shipping import ship

#: The white space that every operator's contract means.
BLANKS = "[\\x20\\x09-\\x0D]"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only on a local master that names none."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of integers as a table; given as Arrow, since a list of tuples goes through Python workers that then stay beside the queries' own."""
    kinds = T.StructType.fromDDL(schema)
    columns = {name: pa.array([row[i] for row in rows], pa.int64()) for i, name in enumerate(kinds.names)}
    return spark.createDataFrame(pa.table(columns)).select(*[F.col(f.name).cast(f.dataType) for f in kinds])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow on workers that can import this package.

    A worker stays for later tasks, so at a task's end what it has freed goes back to the system.
    """
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the latter trims the heap that numpy uses, too
            pool.release_unused()

    return df.mapInArrow(tidy, schema)
