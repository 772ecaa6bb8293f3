"""Files as they arrive: the same stateless functions over a stream.

    stream = pixels(spark, "/in", hdu=1)
    wcs.pixel_to_world(stream, ["x", "y"], ["ra", "dec"]).writeStream...

The stream carries whole files; units that are decoded are rows of the micro-batch
that holds the file, so no state is kept and a restart reads what was not committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.session import ship
from astrolane.sources import container as ct


def files(spark: SparkSession, folder: str, pattern: str = "*.fits*") -> DataFrame:
    """path and content of files as they arrive."""
    ship(spark)
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "content")


def _decode(content: bytes) -> bytes:
    import gzip

    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def headers(stream: DataFrame) -> DataFrame:
    """path, hdu, kind, keyword and value of the cards of arriving files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, u.index, u.kind, c.keyword, None if c.value is None else str(c.value)) for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for u in ct.walk(_decode(raw), with_data=False) for c in u.header.cards]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["path", "hdu", "kind", "keyword", "value"])

    return stream.mapInArrow(run, "path string, hdu int, kind string, keyword string, value string")


def pixels(spark: SparkSession, folder: str, hdu: int = 0, pattern: str = "*.fits*") -> DataFrame:
    """path, x, y and value of the pixels of one unit of arriving files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                u = ct.walk(_decode(raw))[hdu]
                a = ct.physical(u.header, ct.image_raw(u.header, u.raw)) if u.kind == "image" else ct.physical(ct.image_header_of(u.header), ct.decompress(u))
                flat = a.reshape(-1, a.shape[-1]).astype(float)
                for y in range(flat.shape[0]):
                    n = flat.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array(range(n), pa.int64()), pa.array([y] * n, pa.int64()), pa.array(flat[y])], names=["path", "x", "y", "value"])

    return files(spark, folder, pattern).select("path", "content").mapInArrow(run, "path string, x bigint, y bigint, value double")


def pixel_stats(stream: DataFrame) -> DataFrame:
    """Count, least, greatest, mean and deviation of the finite pixels of each file, as a running aggregate."""
    return stream.filter("not isnan(value) and abs(value) < double('Infinity')").groupBy("path").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
