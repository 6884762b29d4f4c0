"""Getting the package to Python workers that can't import it by themselves."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def importable_on_workers() -> bool:
    """The package is installed, or PYTHONPATH names its folder."""
    named = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return ROOT in named or "site-packages" in ROOT or not os.path.isdir(os.path.join(ROOT, "tidewell"))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all workers, once for an application, unless they have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped or importable_on_workers():
        return
    folder = tempfile.mkdtemp(prefix="tidewell-ship-")  # the driver's file server reads it
    path = os.path.join(folder, "tidewell.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(os.path.join(ROOT, "tidewell")):
            for name in sorted(names):
                if name.endswith(".py"):
                    out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), ROOT))
    before = list(sys.path)
    context.addPyFile(path)
    sys.path[:] = before  # the driver goes on with the sources themselves
    _shipped.add(context.applicationId)
