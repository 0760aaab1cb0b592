"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_eventloom_shipped", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="eventloom-")), "eventloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    sc._eventloom_shipped = True
