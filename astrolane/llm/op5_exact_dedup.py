"""Exact deduplication by Grace hash partitioning.

Records are first collapsed where they are read: equal texts of one Arrow batch
become one record that carries the ids of its members, so that a text that a
third of all rows hold reaches the shuffle once a batch.  The records are
written as spill files to the shared folder, partitioned by hash: buckets that
would not fit the table's memory are split again by further bits of the hash
until each fits.  Each bucket then fills an open-addressing table that compares
complete normalised contents; hashes only choose buckets and slots.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from astrolane.llm.common import Scratch, shuffle_partitions, table

_TO_SPACE = bytes(0x20 if 9 <= i <= 13 else i for i in range(256))
_RUNS = re.compile(rb"  +")


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of ASCII white space as one space; null is empty."""
    b = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    return _RUNS.sub(b" ", b) if b"  " in b else b


class OpenTable:
    """Open addressing with linear probing; keys are complete byte strings."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.keys: list[bytes] = []
        self.hashes: list[int] = []

    def find(self, key: bytes, h: int) -> tuple[int, bool]:
        """The entry of the key, and whether it is new."""
        if 2 * (len(self.keys) + 1) > len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and self.keys[entry] == key:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = len(self.keys)
        self.keys.append(key)
        self.hashes.append(h)
        return len(self.keys) - 1, True

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _key(doc_id: int | None) -> tuple[bool, int]:
    """Ids in order, null after all."""
    return (doc_id is None, doc_id or 0)


def _collapse(batches: Iterator[pa.RecordBatch], carry: bool) -> Iterator[pa.RecordBatch]:
    """row, id, text -> a record for each different text of a batch. carry: the row holds the text, which is then not kept beside it."""
    made = TaskContext.get().partitionId() << 40
    for b in batches:
        if not b.num_rows:
            continue
        ids, texts = b.column("_id").to_pylist(), b.column("_text").to_pylist()
        found, first, members, hashes, sizes = OpenTable(), [], [], [], []
        for i, text in enumerate(texts):
            key = normalise(text)
            h = xxhash.xxh64_intdigest(key)
            entry, new = found.find(key, h)
            if new:
                first.append(i)
                members.append([i])
                hashes.append(h)
                sizes.append(len(key))
            else:
                members[entry].append(i)
        for entry, own in enumerate(members):
            own.sort(key=lambda i: _key(ids[i]))
            first[entry] = own[0]
        n = len(first)
        kept = ["_row"] if carry else ["_row", "_text"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(pa.array(first)) for c in kept), pa.array(range(made, made + n), pa.int64()), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array([ids[i] for i in first], pa.int64()), pa.array([[ids[i] for i in own] for own in members], pa.list_(pa.int64()))],
            names=[*kept, "_gid", "_h", "_bytes", "_min", "_members"],
        )
        made += n


def spill(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The collapsed records as spill files. carry: with their first member's whole row, and the text in that only."""
    row = F.struct("*") if carry else F.struct(F.lit(0).alias("x"))
    frame = docs.select(row.alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([frame.schema["_row"], *([] if carry else [frame.schema["_text"]]), *(T.StructField(c, T.LongType()) for c in ("_gid", "_h", "_bytes", "_min")), T.StructField("_members", T.ArrayType(T.LongType()))])
    return scratch.write(frame.mapInArrow(lambda batches: _collapse(batches, carry), schema), "spill")


def bucket_of(records: DataFrame, fit_bytes: int, least: int) -> tuple[Column, int]:
    """The bucket of each record, and how many tasks they are for.

    The first level has so many buckets that an even share fits; those that are
    larger all the same, and hold more than one hash, are split by the next level.
    Only sizes of buckets that don't fit reach the driver.
    """
    total = records.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b")).first()["b"]
    fan = max(least, -(-total // fit_bytes))
    leaf, level = F.pmod(F.col("_h"), F.lit(fan)).cast("string"), 0
    while True:  # each level splits a bucket of several hashes further
        large = [r["leaf"] for r in records.groupBy(leaf.alias("leaf")).agg(F.sum("_bytes").alias("b"), F.min("_h").alias("lo"), F.max("_h").alias("hi")).filter((F.col("b") > 2 * fit_bytes) & (F.col("lo") < F.col("hi"))).select("leaf").collect()]
        if not large:
            break
        level += 1
        leaf = F.when(leaf.isin(large), F.concat_ws("/", leaf, F.pmod(F.xxhash64("_h", F.lit(level)), F.lit(16)).cast("string"))).otherwise(leaf)
    # a task takes bucket after bucket, so it may have several
    return leaf, max(least, -(-total // (4 * fit_bytes)))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole buckets, one bucket after the other -> for each record the group it belongs to."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_leaf", "_gid", "_h", "_text", "_min", "_n")), strict=True))
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        found, least, owner, size, gids, entries = OpenTable(), [], [], [], [], []
        for _, gid, h, text, low, n in own:
            entry, new = found.find(normalise(text), h & 0xFFFFFFFFFFFFFFFF)
            if new:
                least.append(low)
                owner.append(gid)
                size.append(0)
            elif (_key(low), gid) < (_key(least[entry]), owner[entry]):
                least[entry], owner[entry] = low, gid
            size[entry] += n
            gids.append(gid)
            entries.append(entry)
        sha = [hashlib.sha256(k).hexdigest() for k in found.keys]
        for at in range(0, len(gids), 10_000):
            e = entries[at : at + 10_000]
            g = gids[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([least[x] for x in e], pa.int64()), pa.array([size[x] for x in e], pa.int64()), pa.array([owner[x] == y for x, y in zip(e, g, strict=True)]), pa.array([sha[x] for x in e])], names=["_gid", "keep_id", "group_size", "_owner", "text_sha256"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole buckets, one bucket after the other -> the row that stays of each group."""
    every = ((b, i, *r) for b in batches for i, r in enumerate(zip(*(b.column(c).to_pylist() for c in ("_leaf", "_gid", "_h", "_text", "_min")), strict=True)))
    for _, own in itertools.groupby(every, key=lambda r: r[2]):
        found, best, rows = OpenTable(), [], []
        for b, i, _, gid, h, text, low in own:
            entry, new = found.find(normalise(text), h & 0xFFFFFFFFFFFFFFFF)
            rank = (_key(low), gid)
            if new:
                best.append(rank)
                rows.append(b.column("_row").slice(i, 1))
            elif rank < best[entry]:
                best[entry], rows[entry] = rank, b.column("_row").slice(i, 1)
        for at in range(0, len(rows), 2000):
            whole = pa.concat_arrays(rows[at : at + 2000])
            yield pa.RecordBatch.from_arrays([whole], names=["_row"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_bytes: int = 48 << 20, scratch: Scratch | None = None) -> DataFrame:
    """Each row with the group of rows whose normalised text equals its own.

    Returns id, keep_id (the smallest id of the group), group_size, kept and
    text_sha256.  Null text is empty, so all null and empty texts are one group;
    texts of white space alone equal a single space.  Of repeated rows with the
    same smallest id exactly one has kept = true.  Null ids come after all others.
    An empty table gives no rows; other columns of any name are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "dedup")
    records = spill(docs, scratch, id_col, text_col)
    leaf, count = bucket_of(records, fit_bytes, shuffle_partitions(spark))
    thin = records.select("_gid", "_h", "_text", "_min", F.size("_members").cast("long").alias("_n"), leaf.alias("_leaf"))
    decided = thin.repartition(count, "_leaf").sortWithinPartitions("_leaf").mapInArrow(_decide, "_gid long, keep_id long, group_size long, _owner boolean, text_sha256 string")
    each = records.select("_gid", "_members").join(decided, "_gid").select(F.posexplode("_members").alias("_nth", id_col), "keep_id", "group_size", "_owner", "text_sha256")
    return each.select(id_col, "keep_id", "group_size", (F.col("_owner") & (F.col("_nth") == 0)).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_bytes: int = 48 << 20, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all their columns, less those that repeat a text; see exact_groups."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "dedup")
    records = spill(docs, scratch, id_col, text_col, carry=True)
    leaf, count = bucket_of(records, fit_bytes, shuffle_partitions(spark))
    whole = records.select("_row", "_gid", "_h", "_min", leaf.alias("_leaf")).repartition(count, "_leaf").sortWithinPartitions("_leaf").withColumn("_text", F.col("_row").getField(text_col).cast("string"))
    return whole.mapInArrow(_keep, T.StructType([records.schema["_row"]])).select("_row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
