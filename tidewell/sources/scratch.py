"""New folders for a run's tables, where driver and executors both see them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dir: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, in the folder of spark.checkpoint.dir; a local master that names none gets a temporary folder."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="tidewell-runs-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        named = _own_dir
    return f"{named.rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"
