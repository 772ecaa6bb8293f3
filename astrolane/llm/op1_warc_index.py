"""WARC archives with a two-level capture index.

Captures are written as WARC 1.1 records, each a gzip member of its own, so that
any record can be read by a range read.  Of captures with equal payloads one
holds the payload and the others revisit it.

The index has two levels.  Its lines are sorted by reversed-host keys
("com,example,www)/path") and stored in compressed blocks; a sparse directory
holds the first key of each block.  A lookup searches the directory, reads one
block by a range read, searches its lines and reads the record by a range read.
Blocks grow with the corpus so that the directory never has more than MAX_BLOCKS
entries of bounded keys: it is the one thing that is broadcast.

Archives and index files are written through ``pyarrow.fs`` into the shared
folder, under names that hold the attempt; only files of attempts that succeeded
are in the manifest, which is a table.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.llm.common import Scratch, shuffle_partitions, table

#: Payloads of fewer bytes are never revisited.
LEAST_SHARED = 100
MAX_BLOCKS = 100_000
MAX_KEY = 256
#: An archive file is closed at this size.
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The reversed-host key of an URL; long ones are cut and closed by a hash, so that keys stay bounded and apart."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        host, port, parts = "", None, None
    if parts is None or not host:
        key = url.lower()
    else:
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    key = quote(key, safe="!$%&'()*+,-./:;=?@_~")
    return key if len(key) <= 200 else key[:158] + "~" + hashlib.sha1(key.encode()).hexdigest()


def capture_key(url: str | None, page_id: int | None) -> str:
    """A capture's key: equal URLs follow each other by page id."""
    return f"{surt(url)} " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record, its payload (None for a revisit) and the payload's full size. Verifies length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/1."):
        raise ValueError("no WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    name = lambda x: int(x[len("<urn:x-page:") : -1]) if x and len(x) > len("<urn:x-page:>") else None
    out = {"page_id": name(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": name(fields.get("WARC-Refers-To")), "bytes": size, "payload": None}
    if out["type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != out["digest"]:
            raise ValueError(f"record {out['page_id']} is damaged")
        out["payload"] = payload
    return out


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, and the path there."""
    return pafs.FileSystem.from_uri(base if "://" in base else "file://" + base.removeprefix("file:"))


def _attempt(kind: str) -> str:
    t = TaskContext.get()
    return f"{kind}-{t.partitionId():06d}-{t.taskAttemptId()}"


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the manifest.

    Manifest: key, page_id, file, offset, length of each record.  Null html is an
    empty payload; null URLs and ids are written without; rows with the least id of
    equal payloads are all responses where they repeat; an empty table gives no
    files.  Other columns of any name are ignored.
    """
    base = f"{scratch.path}/archives"
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.filter(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    # the few shared digests meet the pages once; the optimiser splits a digest that many pages hold
    marked = rows.join(shared, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    marked = marked.select("page_id", "url", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("size"), "digest", "first", "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _open(base)
        where.create_dir(folder, recursive=True)
        out, at, part, name = None, 0, 0, ""
        try:
            for b in batches:
                made = []
                for page_id, url, payload, size, digest, first, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "first", "revisit")), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, part = f"{_attempt('captures')}-{part:04d}.warc.gz", 0, part + 1
                        out = where.open_output_stream(f"{folder}/{name}", compression=None)
                    raw = record(page_id, url, _Sized(size) if revisit else payload, digest, first, revisit)
                    raw = gzip.compress(raw, 3, mtime=0)
                    out.write(raw)
                    made.append((capture_key(url, page_id), page_id, name, at, len(raw)))
                    at += len(raw)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return scratch.write(marked.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "manifest")


class _Sized:
    """A payload that is not at hand, of known size."""

    def __init__(self, size: int):
        self.size = size

    def __len__(self) -> int:
        return self.size


class CaptureIndex:
    """The directory: first key of each block, and where the block is."""

    def __init__(self, base: str, keys: list[str], places: list[tuple[str, int, int]]):
        self.base, self.keys, self.places = base, keys, places

    def blocks(self, key: str) -> range:
        """Blocks that may hold the key: usually one, more where a key fills blocks."""
        last = bisect.bisect_right(self.keys, key) - 1
        first = bisect.bisect_left(self.keys, key) - 1
        return range(max(first, 0), last + 1)


def build_index(manifest: DataFrame, scratch: Scratch, block_lines: int = 500) -> CaptureIndex:
    """Sorts the manifest's lines by key into compressed blocks and gathers the sparse directory.

    block_lines: lines of a block; taken as more where the directory would pass MAX_BLOCKS entries.
    """
    base = f"{scratch.path}/index"
    block_lines = max(block_lines, -(-manifest.count() // MAX_BLOCKS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _open(base)
        where.create_dir(folder, recursive=True)
        lines = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True))
        name, at, rows = f"{_attempt('blocks')}.idx", 0, []
        first = next(lines, None)
        if first is None:
            return
        with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for block in itertools.batched(itertools.chain([first], lines), block_lines):
                raw = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
                out.write(raw)
                rows.append((block[0][0], name, at, len(raw)))
                at += len(raw)
        for own in itertools.batched(rows, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["first", "file", "offset", "length"])

    ordered = manifest.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    directory = scratch.write(ordered.mapInArrow(build, "first string, file string, offset long, length long"), "directory")
    rows = sorted((r["first"], r["file"], r["offset"], r["length"]) for r in directory.collect())  # MAX_BLOCKS at most, and one for each partition
    return CaptureIndex(base, [r[0] for r in rows], [r[1:] for r in rows])


class _Files:
    """Open files of one folder, a few at a time."""

    def __init__(self, base: str, most: int = 16):
        self.where, self.folder = _open(base)
        self.open: dict[str, pa.NativeFile] = {}
        self.most = most

    def read(self, name: str, offset: int, length: int) -> bytes:
        """A range read."""
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.where.open_input_file(f"{self.folder}/{name}")
        return self.open[name].read_at(length, offset)


def lookup(wanted: DataFrame, index: CaptureIndex) -> DataFrame:
    """Records of the captures in wanted (page_id, url): page_id, file, offset, length of each.

    A capture that is wanted twice is found once; one that is not there gives no row.
    """
    shared = wanted.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in batches:
            rows = [(k, block) for k in map(capture_key, b.column("url").to_pylist(), b.column("page_id").to_pylist()) for block in found.blocks(k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.int64())], names=["key", "block"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, files, at, keys, lines, before = shared.value, _Files(shared.value.base), None, [], [], None
        for b in batches:
            rows = []
            for key, block in zip(b.column("key").to_pylist(), b.column("block").to_pylist(), strict=True):
                if (key, block) == before:
                    continue
                before = (key, block)
                if block != at:
                    lines = [json.loads(x) for x in zlib.decompress(files.read(*found.places[block])).decode().split("\n")]
                    at, keys = block, [x[0] for x in lines]
                rows += [tuple(lines[i][1:]) for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    keys = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(search, "key string, block long")
    return keys.repartition("block").sortWithinPartitions("block", "key").mapInArrow(probe, "file string, offset long, length long")


def read_records(places: DataFrame, scratch: Scratch, with_payload: bool = False) -> DataFrame:
    """Reads records by range reads, in the order in which they lie in their files, and parses them.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).
    """
    base = f"{scratch.path}/archives"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(base)
        for b in batches:
            for own in itertools.batched(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True), 2000):
                got = [parse(gzip.decompress(files.read(*x))) for x in own]
                cols = [("page_id", pa.int64(), "page_id"), ("url", pa.string(), "url"), ("payload_bytes", pa.int64(), "bytes"), ("payload_digest", pa.string(), "digest"), ("record_type", pa.string(), "type"), ("refers_to", pa.int64(), "refers_to")] + [("payload", pa.binary(), "payload")] * with_payload
                yield pa.RecordBatch.from_arrays([pa.array([g[f] for g in got], t) for _, t, f in cols], names=[n for n, _, _ in cols])

    stretch = places.withColumn("part", F.floor(F.col("offset") / (4 << 20)))
    # a number of its own: the pointers are small, what they point at isn't
    return stretch.repartition(shuffle_partitions(places.sparkSession), "file", "part").sortWithinPartitions("file", "offset").drop("part").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    scratch = Scratch(spark, "warc")
    index = build_index(write_archives(pages, scratch), scratch)
    return read_records(lookup(pages, index), scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
