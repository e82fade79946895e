"""Make the package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send a zip of the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp()) / "package"  # served by the driver as long as the application runs
        atexit.register(shutil.rmtree, out.parent, ignore_errors=True)
        shutil.copytree(here, out / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{out}-{app}", "zip", out))
        shutil.rmtree(out)
        _shipped.add(app)
    return spark
