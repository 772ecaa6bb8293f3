"""Checks of the order of rows, without a window over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def falls(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how often `value` is less than in the row before, in order of `key`. Nulls compare with nothing.

    Rows are dealt by ranges of the key; a task counts inside its range and tells
    its first and last value, a row for each task, and those are compared then.
    """
    kind = df.select(value).schema[0].dataType.simpleString()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down, first, last = 0, None, None
        for b in batches:
            x = b.column(value)
            if not len(x):
                continue
            if last is None:
                first = x.slice(0, 1)
            elif last[0].is_valid and x[0].is_valid:
                down += bool(pc.less(x[0], last[0]).as_py())
            down += pc.sum(pc.less(x.slice(1), x.slice(0, len(x) - 1))).as_py() or 0
            last = x.slice(len(x) - 1, 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([down], pa.int64()), first, last], names=["part", "down", "first", "last"])

    ranges = df.select(key, value).repartitionByRange(key).sortWithinPartitions(key).mapInArrow(inside, f"part int, down long, first {kind}, last {kind}")
    border = F.lag("last").over(Window.orderBy("part"))  # a row for each task
    return ranges.withColumn("before", border).agg(F.coalesce(F.sum(F.col("down") + F.when(F.col("first") < F.col("before"), 1).otherwise(0)), F.lit(0)).alias("down"))


def first_with_total(df: DataFrame, key: str, n: int, total: str = "total") -> DataFrame:
    """The first n rows by `key`, each with the number of all rows."""
    return df.orderBy(key).limit(n).crossJoin(df.agg(F.count(F.lit(1)).alias(total)))  # with one row
