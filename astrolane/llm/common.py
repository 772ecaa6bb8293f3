"""Shared plumbing of the training-data operators.

Scratch tables live under the folder named by ``spark.checkpoint.dir`` so that
every executor and the driver see the same files; a folder of our own is made
only where that setting is unset (local tests).
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.session import ship

#: The ASCII white space that separates words in every text operator.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark only."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a cluster it has to be set; a local run gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="astrolane-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """A folder of intermediate tables in the shared folder.

    ``write`` materialises a frame as Parquet and reads it back, which cuts the
    lineage and lets later passes prune columns.  ``drop`` removes the folder;
    what is not dropped goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str = "job"):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/astrolane-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Shuffle files of tables that have been written go now, not when the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        try:
            jvm = self.spark._jvm
            if jvm is None or self.spark.sparkContext._jsc is None:
                return
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: nothing left to ask
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
