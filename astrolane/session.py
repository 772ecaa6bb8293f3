"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_astrolane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="astrolane-"), "astrolane.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, Path("astrolane") / p.relative_to(root))
        sc.addPyFile(path)
    sc._astrolane_shipped = True


def get_spark(name: str = "astrolane", **conf: str) -> SparkSession:
    """A session with what the engine relies on: adaptive plans, UTC, filters pushed to Python sources."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.python.filterPushdown.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark
