"""Makes the package importable in the Python workers of a running session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark application, as a zip of its sources."""
    sc = spark.sparkContext
    if getattr(sc, "_fluvispark_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="fluvispark-"), "fluvispark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("fluvispark", os.path.relpath(full, ROOT)))
    sc.addPyFile(path)
    sc._fluvispark_shipped = True
