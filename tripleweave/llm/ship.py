"""Sends the package's code to the executors, wherever the driver found it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import tripleweave

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(tripleweave.__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="ship-")  # the driver's own; Spark copies the file from here
        sc.addPyFile(shutil.make_archive(f"{folder}/tripleweave", "zip", root.parent, root.name))
        _SENT.add(sc.applicationId)
    return spark
