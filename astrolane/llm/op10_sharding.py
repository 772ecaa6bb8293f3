"""Sharding by jump consistent hash.

A stable 64-bit key is drawn from the document id alone, and the jump hash
(Lamping and Veach, 2014) maps it to a shard without a ring table: going from
n to n + 1 shards moves about 1 / (n + 1) of the keys, all of them into the new
shard.  Slots number the rows of a shard without gaps; they are made from the
sizes of (shard, bucket) cells and a row number inside each cell, so no shard is
ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolane.llm.common import Scratch, table, text_or_empty

#: Multiplier of the published jump hash.
JUMP = np.uint64(2862933555777941757)
#: Key of a row without an id.
NULL_KEY = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: stable 64-bit keys from integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, 0 to shards - 1."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = keys.astype(np.uint64).copy()
    at = np.full(len(key), -1, dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            key[live] = key[live] * JUMP + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead[live] = ((at[live] + 1).astype(np.float64) * step).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def shard_rows(docs: DataFrame, shards: int = 24, rows_per_cell: int = 100_000, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Every row with its shard and its gapless slot there.

    shards: how many there are; ``grown_shard`` tells where a row goes with one
    more.  rows_per_cell: about so many rows of a shard are numbered at once; their
    cells, a row for each in a broadcast table, grow with the rows.  Null text counts as empty, a null id
    takes a fixed key; rows with equal ids share a shard and get different slots;
    an empty table gives no rows; other columns of any name are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "shards")
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
    )

    buckets = max(1, -(-docs.count() // (shards * rows_per_cell)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            keys = splitmix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            keys[ids.is_null().to_numpy(zero_copy_only=False)] = NULL_KEY
            more = [pa.array(jump_hash(keys, shards).astype(np.int32)), pa.array(jump_hash(keys, shards + 1).astype(np.int32)), pa.array((splitmix(keys) % np.uint64(buckets)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket"])

    placed = scratch.write(thin.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, bucket int"), "placed")
    # a row for rows_per_cell rows of the table
    cells = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(within))
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 24)
