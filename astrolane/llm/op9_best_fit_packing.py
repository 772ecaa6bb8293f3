"""Best-fit packing of token sequences, bulk-synchronously.

Lengths are whole numbers up to the capacity, so documents and gaps fall into
that many classes at most, whatever the size of the corpus.  A round sorts both
sides, sweeps every class of documents to its successor (the smallest gap that
holds it), resolves conflicts by rank (the longest document first, as many as
there are gaps) and updates the gaps; classes that no gap holds open sequences,
the longest class first; then the next round starts.  The rounds exchange class
counts only.  Which document meets which sequence follows from ranks: a
document's rank in its class, made in a distributed window, is looked up in the
runs of ranks that the rounds laid down.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolane.llm.common import Scratch, table

MODEL = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
_ODD_SPACE = re.compile(r"[^\S \n]")
_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


class ByteCoder:
    """Token ids of texts as the library gives them, as little-endian 32-bit words.

    The model's pattern never joins a character that is no space to a space behind
    it, so a text can be cut there, and the parts are looked up; texts with spaces
    other than blank and newline, or with special strings, go to the library whole.
    ranks: a file with the same vocabulary as ranks, which encodes parts that are
    not known yet faster.  Parts are kept in two generations: what is still in use
    moves on when the younger one is full.
    """

    def __init__(self, path: str, ranks: str | None = None, cache: int = 250_000):
        self.lib = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache = cache
        self.fast = None
        if ranks:
            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(r) for a, r in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, text: str) -> bytes:
        """Ids of a part that the younger generation doesn't have."""
        made = self.old.get(text)
        if made is None:
            ids = self.fast.encode_ordinary(text) if self.fast else self.lib.encode(text, add_special_tokens=False).ids
            made = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= 64:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[text] = made
        return made

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        parts = _PIECES.findall(text)
        got = list(map(self.young.get, parts))
        if None in got:
            part = self.part
            got = [part(p) if v is None else v for p, v in zip(parts, got, strict=True)]
        return b"".join(got)


_CODERS: dict[str, ByteCoder] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens; the first one may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int, end_id: int | None, model_path: str, ranks: str | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    frame = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CODERS.get(model_path) or _CODERS.setdefault(model_path, ByteCoder(model_path, ranks))
        for b in batches:
            for low in range(0, b.num_rows, 500):  # texts of a slice only are Python's at a time
                some, rows = b.slice(low, 500), []
                for i, text in zip(some.column("_id").to_pylist(), some.column("_text").to_pylist(), strict=True):
                    raw = coder.ids(text) + tail
                    rows += [(i, k, at, n, binascii.crc32(raw[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(raw) // 4, capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return frame.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def rounds(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) that place counts[n] documents of each length n.

    Length 0 (no tokens) needs no room: such documents go to offset 0 of the first sequence.
    """
    left = counts.astype(np.int64).copy()
    rank = np.zeros(capacity + 1, dtype=np.int64)  # of the next document of each length
    gaps: list[deque[list[int]]] = [deque() for _ in range(capacity + 1)]  # runs [first sequence, how many] by gap
    room = np.zeros(capacity + 1, dtype=np.int64)
    out, opened = [], 0
    if left[0]:
        out.append((0, 0, int(left[0]), 0, 0))
        left[0] = 0
    while (waiting := np.flatnonzero(left)).size:
        open_gaps = np.flatnonzero(room)
        at = np.searchsorted(open_gaps, waiting)  # successor sweep
        fits = at < len(open_gaps)
        placed: list[tuple[int, int, int]] = []  # gap and run of sequences that are left, put in place after the round
        for k in range(len(waiting) - 1, -1, -1):  # by rank: the longest first
            if not fits[k]:
                continue
            n, gap = int(waiting[k]), int(open_gaps[at[k]])
            take = int(min(left[n], room[gap]))
            left[n] -= take
            room[gap] -= take
            while take:
                run = gaps[gap][0]
                some = min(take, run[1])
                out.append((n, int(rank[n]), some, run[0], capacity - gap))
                placed.append((gap - n, run[0], some))
                rank[n] += some
                take -= some
                if some == run[1]:
                    gaps[gap].popleft()
                else:
                    run[0] += some
                    run[1] -= some
        homeless = waiting[~fits]
        if homeless.size:
            n = int(homeless[-1])
            out.append((n, int(rank[n]), int(left[n]), opened, 0))
            placed.append((capacity - n, opened, int(left[n])))
            opened += int(left[n])
            rank[n] += left[n]
            left[n] = 0
        for gap, first, some in placed:
            gaps[gap].append([first, some])
            if gap:
                room[gap] += some
    return out


def pack(docs: DataFrame, capacity: int = 1024, end_id: int | None = 2, model_path: str | None = None, ranks: str | None = None, rows_per_cell: int = 100_000, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    Every sequence is filled without gaps from offset 0 and holds capacity tokens
    at most.  ranks: the model's vocabulary as a rank file, if there is one.  end_id: appended to each document, or None.  rows_per_cell: about
    so many pieces of a length class are ranked at once.  Null text is
    empty and gives the one piece of the end id; repeated rows are packed each;
    an empty table gives no rows; other columns of any name are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    if model_path is None:
        model_path, ranks = public_tokenizers.path(MODEL), public_tokenizers.path(RANKS)
    pieces = scratch.write(token_pieces(docs, capacity, end_id, model_path, ranks, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)  # of pieces by length
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    runs = np.array(sorted(rounds(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    # a length class has cells by its size: capacity + 1 and one for rows_per_cell pieces, all in all
    buckets = np.maximum(1, -(-counts // rows_per_cell))
    place_of = np.cumsum(buckets) - buckets
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.array(*map(F.lit, buckets.tolist())), F.col("length").cast("int") + 1)).cast("int").alias("bucket")
    grid = np.zeros(int(buckets.sum()), dtype=np.int64)
    if buckets.max() > 1:
        cells = pieces.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n")).toPandas()
        grid[place_of[cells["length"]] + cells["bucket"]] = cells["n"]
    before = np.cumsum(grid) - grid
    first = before - np.repeat(before[place_of], buckets)
    shared = spark.sparkContext.broadcast((place_of, first, runs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of, first, runs = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = first[place_of[length] + b.column("bucket").to_numpy()] + b.column("nth").to_numpy() - 1
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            made = [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *made], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("bucket", bucket).withColumn("nth", nth.cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 1024, 2)
