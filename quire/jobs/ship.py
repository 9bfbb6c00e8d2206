"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; a package that is installed there already is the same one."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    top = tempfile.mkdtemp(prefix="spark-ship-")
    shutil.copytree(os.path.join(root, "quire"), os.path.join(top, "src", "quire"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(top, f"quire-{app}"), "zip", os.path.join(top, "src")))
    _SHIPPED.add(app)
