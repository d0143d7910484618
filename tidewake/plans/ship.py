"""Gives the package to the workers, so that queries run from any folder and on machines that haven't installed it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_given: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of the package (well under a megabyte), which Spark sends to its executors."""
    context = spark.sparkContext
    if context.applicationId in _given:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidewake-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/tidewake-code", "zip", package.parent, package.name))
    _given.add(context.applicationId)
