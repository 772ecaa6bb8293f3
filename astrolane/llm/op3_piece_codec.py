"""SentencePiece encoding and decoding by a max-plus parallel scan.

A long text is cut into chunks of equal length, at any character.  What crosses
a cut is one piece, so the states of a boundary are the pieces that could end on
or stretch over it.  Each chunk, on its own, yields a transfer matrix: for each
state on its left and each on its right the best weight (minus the number of
tokens) of a chain of compatible pieces between them, minus infinity where there
is none.  The max-plus product of matrices is associative; a scan over the
chunks of a text finds the state at every boundary, and each chunk then traces
its own tokens back, independently.  Texts of one chunk need no scan.

Between two word starts that lie in the same chunk all states meet in one, so
the inside of a chunk is a lookup of words, and only its ragged ends hold more
than one state.
"""

from __future__ import annotations

import binascii
import functools
import itertools
import operator
import pickle
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.llm.common import Scratch, table
from astrolane.llm.pieces import MARK, UNKNOWN, Kept, PieceModel, model

MODEL = "piece_bpe_32k.model"
#: The one state where a word starts at the boundary itself: nothing stretches over it.
MEET = (UNKNOWN, 0)
State = tuple[str, int]  # the piece, and how far it stretches over the boundary
Matrix = dict[State, dict[State, int]]
Chain = tuple[int, list[str | None], list[int]]  # where it begins; of each prefix the last piece, None where there is none, and the tokens


class ChunkCoder:
    """Chunks of a marked text: their matrices and their tokens. Keeps the tokens of words."""

    def __init__(self, pieces: PieceModel):
        self.pieces = pieces
        self.kept = Kept(lambda word: array("I", pieces.lib.encode(word[1:]) if len(word) > 1 else [pieces.ids[MARK]]).tobytes())

    def words(self, marked: str) -> bytes:
        return b"".join(self.kept.many(marked))

    def starts(self, text: str, at: int) -> bool:
        """Whether a word starts at text[at], which is behind another character."""
        return text[at] == MARK and text[at - 1] != MARK

    def split(self, text: str, left: int, right: int) -> tuple[int, int]:
        """The first and the last word start inside (left, right), or right + 1 where there is none."""
        first = left + 1
        while first < right and not self.starts(text, first):
            nxt = text.find(MARK, first + 1, right)
            if nxt < 0:
                return right + 1, right + 1
            first = nxt
        if first >= right:
            return right + 1, right + 1
        last = text.rfind(MARK, first, right)
        while not self.starts(text, last):
            last = text.rfind(MARK, first, last)
        return first, last

    def states(self, text: str, at: int) -> list[State]:
        """What may end on or stretch over the boundary before text[at]."""
        if at == 0 or at >= len(text) or self.starts(text, at):
            return [MEET]
        far, reached = self.pieces.longest, self.pieces.reached
        out = [(text[j:e], e - at) for j in range(max(0, at - far), at) for e in range(at, min(len(text), j + far) + 1) if text[j:e] in reached]
        if text[at - 1] not in self.pieces.ids:
            out.append((UNKNOWN, 0))
        return out

    def run(self, text: str, state: State, left: int, stop: int) -> Chain:
        """Prefix chains from a state at the boundary `left` up to `stop`; where they start."""
        piece, over = state
        begin = left + over
        last, count = self.pieces.prefixes(text[begin:stop], piece)
        return begin, last, count

    def matrix(self, text: str, left: int, right: int, end: bool) -> Matrix:
        """From the states at `left` to those at `right`. text: the chunk with its context; end: whether the text ends at `right`."""
        out: Matrix = {}
        first, last_start = self.split(text, left, right)
        exits = [MEET] if end else self.states(text, right)
        stop = right if end else min(len(text), right + self.pieces.longest)
        states = self.states(text, left)
        if first > right:  # no word starts inside
            for state, chain in self.chains(text, states, left, stop):
                if row := self._exits(chain, text, right, exits, end):
                    out[state] = row
            return out
        tail = self._exits(self.run(text, MEET, last_start, stop), text, right, exits, end)
        inside = len(self.words(text[first:last_start])) // 4 if last_start > first else 0
        for state, (begin, last, count) in self.chains(text, [s for s in states if left + s[1] <= first], left, first):
            if tail and last[first - begin] is not None:
                out[state] = {x: w - inside - count[first - begin] for x, w in tail.items()}
        return out

    def chains(self, text: str, states: list[State], left: int, stop: int) -> Iterator[tuple[State, Chain]]:
        """What run() gives for each state. Chains that agree on as many places as a piece is long are the same from there on."""
        far, known = self.pieces.longest, []
        for state in states:
            begin = left + state[1]
            body = text[begin:stop]
            last, count, at = [state[0], *[None] * len(body)], [0] * (len(body) + 1), 0
            while at < len(body):
                at, since = min(len(body), at + 4 * far), at + 1
                self.pieces.extend(body[:at], last, count, since)
                own = last[at - far + 1 : at + 1]
                if at < far or at == len(body):
                    continue
                if not any(x is not None for x in own):
                    break
                for begin2, last2, count2 in known:
                    at2 = at + begin - begin2
                    if at2 - far >= 0 and last2[at2 - far + 1 : at2 + 1] == own:
                        ahead = {x - y for x, y, p in zip(count[at - far + 1 : at + 1], count2[at2 - far + 1 : at2 + 1], own, strict=True) if p is not None}
                        if len(ahead) == 1:
                            more = ahead.pop()
                            last[at + 1 :], count[at + 1 :] = last2[at2 + 1 :], [x + more for x in count2[at2 + 1 :]]
                            at = len(body)
                            break
            else:
                if len(known) < 2 * far:
                    known.append((begin, last, count))
            yield state, (begin, last, count)

    def _exits(self, chain: Chain, text: str, right: int, exits: list[State], end: bool) -> dict[State, int]:
        begin, last, count = chain
        row: dict[State, int] = {}
        for piece, over in exits:
            at = right + over - begin
            if not 0 <= at < len(last) or last[at] is None:
                continue
            if (piece, over) == MEET and (end or self.starts(text, right)):
                row[MEET] = -count[at]
            elif last[at] == piece and at > 0:
                row[piece, over] = -count[at]
        return row

    def trace(self, text: str, left: int, right: int, enter: State, leave: State) -> bytes:
        """Tokens that start in the chunk, as little-endian 32-bit ids."""
        first, last_start = self.split(text, left, right)
        stop = right + leave[1]
        if first > right:
            begin, last, _ = self.run(text, enter, left, stop)
            return np.array(self.pieces.backtrace(text[begin:stop], last, stop - begin), dtype="<u4").tobytes()
        begin, last, _ = self.run(text, enter, left, first)
        head = np.array(self.pieces.backtrace(text[begin:first], last, first - begin), dtype="<u4").tobytes()
        inside = self.words(text[first:last_start]) if last_start > first else b""
        _, last, _ = self.run(text, MEET, last_start, stop)
        return head + inside + np.array(self.pieces.backtrace(text[last_start:stop], last, stop - last_start), dtype="<u4").tobytes()


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    out: Matrix = {}
    for s, row in a.items():
        best: dict[State, int] = {}
        for t, w in row.items():
            for u, v in b.get(t, {}).items():
                if w + v > best.get(u, -1 << 62):
                    best[u] = w + v
        if best:
            out[s] = best
    return out


def scan(matrices: list[Matrix], enter: State = MEET, leave: State = MEET) -> list[State]:
    """The state at each boundary of the best chain through all matrices, from one state to another."""
    forward = [{enter: {enter: 0}}]
    for m in matrices:
        forward.append(product(forward[-1], m))
    states = [leave]
    for k in range(len(matrices) - 1, -1, -1):
        reach = forward[k][enter]
        states.append(max((s for s in reach if states[-1] in matrices[k].get(s, {})), key=lambda s: reach[s] + matrices[k][s][states[-1]]))
    return states[::-1]


def cuts(marked: str, chunk: int) -> list[int]:
    """Chunk borders, at any character."""
    return [*range(0, max(len(marked), 1), chunk), len(marked)]


_CODERS: dict[str, ChunkCoder] = {}


def _coder(path: str) -> ChunkCoder:
    return _CODERS.get(path) or _CODERS.setdefault(path, ChunkCoder(model(path)))


def matrices(coder: ChunkCoder, text: str, edges: list[int], ends: bool) -> list[Matrix]:
    """The matrix of each chunk between edges. text: the chunks with their context; ends: whether it ends at the last edge."""
    meets = [e == 0 or coder.starts(text, e) for e in edges[:-1]] + [ends or coder.starts(text, edges[-1])]
    return [{MEET: {MEET: 0}} if m and n else coder.matrix(text, a, b, ends and b == edges[-1]) for (a, b), (m, n) in zip(itertools.pairwise(edges), itertools.pairwise(meets), strict=True)]


def traces(coder: ChunkCoder, text: str, edges: list[int], states: list[State]) -> Iterator[bytes]:
    """The tokens of each chunk between edges, as little-endian 32-bit ids."""
    for (a, b), (s, t) in zip(itertools.pairwise(edges), itertools.pairwise(states), strict=True):
        whole = s == t == MEET and (a == 0 or coder.starts(text, a)) and (b == len(text) or coder.starts(text, b))
        yield coder.words(text[a:b]) if whole else coder.trace(text, a, b, s, t)


def encode_chunks(coder: ChunkCoder, text: str, chunk: int) -> list[bytes]:
    """All steps for one text in this process: matrices, scan, traces."""
    if not text:
        return [b""]
    marked = MARK + text.replace(" ", MARK)
    edges = cuts(marked, chunk)
    return list(traces(coder, marked, edges, scan(matrices(coder, marked, edges, True))))


#: Chunks of a block, which is the part of a text that a task takes at once.
BLOCK = 16

Batches = Iterator[pa.RecordBatch]
#: What encode gives, behind the id.
ENCODED = "text_key long, chunk int, chunks int, ids array<int>"


class Encoder:
    """The two ways of a frame's texts: short ones in one pass, giant ones by chunks, scan and traces.

    Each returns id, text_key, chunk, chunks and ids; ``then`` is a function of
    those batches that runs in the same Python process, with the schema it makes.
    """

    def __init__(self, docs: DataFrame, path: str, chunk: int, id_col: str, text_col: str, scratch: Scratch):
        self.path, self.chunk, self.id_col, self.scratch = path, chunk, id_col, scratch
        self.frame = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
        self.id_field = f"`{id_col}` {self.frame.schema['_id'].dataType.simpleString()}"
        self.giant = F.char_length("_text") >= chunk

    def short(self, then: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
        path, id_col = self.path, self.id_col

        def run(batches: Batches) -> Batches:
            coder, at = _coder(path), TaskContext.get().partitionId() << 40
            for b in batches:
                for low in range(0, b.num_rows, 500):
                    part = b.slice(low, 500)
                    flat = [coder.words(MARK + t.replace(" ", MARK)) if t else b"" for t in part.column("_text").to_pylist()]
                    n = len(flat)
                    ends = np.cumsum([0, *(len(x) // 4 for x in flat)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), dtype="<u4").astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(range(at, at + n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), ids], names=[id_col, "text_key", "chunk", "chunks", "ids"])
                    at += n

        fused = (lambda batches: then(run(batches))) if then else run
        return self.frame.filter(~self.giant).mapInArrow(fused, schema or f"{self.id_field}, {ENCODED}")

    def giants(self, then: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
        path, id_col, chunk = self.path, self.id_col, self.chunk
        span = chunk * BLOCK

        def cut(batches: Batches) -> Batches:
            """Blocks with what surrounds them."""
            coder, at = _coder(path), (TaskContext.get().partitionId() << 40) | 1 << 39
            far = coder.pieces.longest + 1
            for b in batches:
                for i, text in enumerate(b.column("_text").to_pylist()):
                    marked = MARK + text.replace(" ", MARK)
                    n = len(marked)
                    for low in range(0, n, span):
                        begin, high = max(0, low - far), min(n, low + span)
                        made = ([at], [low // span], [-(-n // span)], [-(-n // chunk)], [marked[begin : high + far]], [low - begin], [high - begin])
                        yield pa.RecordBatch.from_arrays([b.column("_id").slice(i, 1), *(pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True))], names=[id_col, "text_key", "block", "blocks", "chunks", "part", "left", "right"])
                    at += 1

        def multiply(batches: Batches) -> Batches:
            """The matrix of each block."""
            coder = _coder(path)
            for b in batches:
                made = []
                for part, left, right, k, n in zip(*(b.column(c).to_pylist() for c in ("part", "left", "right", "block", "blocks")), strict=True):
                    made.append(pickle.dumps(functools.reduce(product, matrices(coder, part, [*range(left, right, chunk), right], k == n - 1))))
                yield pa.RecordBatch.from_arrays([b.column("text_key"), b.column("block"), pa.array(made, pa.binary())], names=["text_key", "block", "matrix"])

        def solve(batches: Batches) -> Batches:
            """The matrices of whole texts, in order -> the states around each block."""
            for key, rows in itertools.groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["text_key"]):
                states = scan([pickle.loads(r["matrix"]) for r in rows])
                n = len(states) - 1
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([pickle.dumps(x) for x in itertools.pairwise(states)], pa.binary())], names=["text_key", "block", "states"])

        def trace(batches: Batches) -> Batches:
            """Blocks, and the states around them where a text has several -> the tokens of their chunks."""
            coder = _coder(path)
            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("part", "left", "right", "block", "blocks", "chunks", "states")]
                for i, (part, left, right, k, n, chunks, around) in enumerate(zip(*columns, strict=True)):
                    edges = [*range(left, right, chunk), right]
                    states = scan(matrices(coder, part, edges, k == n - 1), *(pickle.loads(around) if around else (MEET, MEET)))
                    ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in traces(coder, part, edges, states)]
                    m, first = len(ids), k * (span // chunk)
                    yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array([i] * m)), b.column("text_key").take(pa.array([i] * m)), pa.array(range(first, first + m), pa.int32()), pa.array([chunks] * m, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "text_key", "chunk", "chunks", "ids"])

        blocks = self.scratch.write(self.frame.filter(self.giant).mapInArrow(cut, f"{self.id_field}, text_key long, block int, blocks int, chunks int, part string, `left` int, `right` int"), "blocks")
        several = blocks.filter("blocks > 1")
        products = several.mapInArrow(multiply, "text_key long, block int, matrix binary")
        states = self.scratch.write(products.repartition("text_key").sortWithinPartitions("text_key", "block").mapInArrow(solve, "text_key long, block int, states binary"), "states")
        fused = (lambda batches: then(trace(batches))) if then else trace
        known = blocks.filter("blocks = 1").withColumn("states", F.lit(None).cast("binary"))
        return known.unionByName(several.join(states, ["text_key", "block"])).mapInArrow(fused, schema or f"{self.id_field}, {ENCODED}")


def encode(docs: DataFrame, model_path: str | None = None, chunk: int = 16_384, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Token ids of each text, a row for each chunk: id, text_key, chunk, chunks, ids (array of int).

    The ids of a text are those of its chunks in order and equal the library's.
    text_key tells rows with equal ids apart.  Null and empty texts give one chunk
    without ids; repeated rows are encoded each; an empty table gives no rows; a
    text of any length is encoded whole; other columns of any name are ignored.
    chunk: characters of a chunk, 64 or more.
    """
    e = encoder(docs, model_path, chunk, id_col, text_col, scratch)
    return e.short().unionByName(e.giants())


def encoder(docs: DataFrame, model_path: str | None = None, chunk: int = 16_384, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> Encoder:
    if chunk < 64:
        raise ValueError("chunk must be 64 or more")
    return Encoder(docs, model_path or public_tokenizers.path(MODEL), chunk, id_col, text_col, scratch or Scratch(docs.sparkSession, "pieces"))


_BYTES = re.compile("[\udc80-\udcff]")


def decode_ids(table_: list[str], ids: list[int]) -> str:
    """Text of token ids; bytes of one character are put together; marks become spaces."""
    text = "".join(map(table_.__getitem__, ids))
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if _BYTES.search(text) else text


_TABLES: dict[str, list] = {}


def piece_table(path: str) -> list[str]:
    """What each id stands for: text, or a byte, those from 128 on as escapes; control ids are nothing."""
    if path not in _TABLES:
        m = model(path)
        table_ = [""] * m.lib.get_piece_size()
        for p, i in m.ids.items():
            table_[i] = p.replace(MARK, " ")
        for value, i in enumerate(m.byte_ids):
            table_[i] = chr(value) if value < 128 else chr(0xDC00 + value)
        table_[m.lib.unk_id()] = " ⁇ "
        _TABLES[path] = table_
    return _TABLES[path]


def decoded(path: str) -> Callable[[Batches], Batches]:
    """Batches of ids with the column ``decoded``."""

    def run(batches: Batches) -> Batches:
        pieces = piece_table(path)
        for b in batches:
            made = []
            for k, ids in zip(b.column("chunk").to_pylist(), b.column("ids"), strict=True):
                text = decode_ids(pieces, ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else [])
                made.append(text[1:] if k == 0 and text[:1] == " " else text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "decoded"])

    return run


def decode(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """Adds the column ``decoded``, the text of a chunk, to what encode returns.

    The text of a document is that of its chunks in order.  Null ids give an empty text.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(decoded(model_path or public_tokenizers.path(MODEL)), fields + ", decoded string")


def _applied(rows: list[int], x: int) -> int:
    return functools.reduce(operator.xor, (r for k, r in enumerate(rows) if x >> k & 1), 0)


@functools.cache
def _zeros(k: int) -> list[int]:
    """What 2 ** k zero bits behind make of each bit of a CRC-32."""
    if not k:
        return [0xEDB88320, *(1 << i for i in range(31))]
    half = _zeros(k - 1)
    return [_applied(half, r) for r in half]


def crc_of_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings put together, from that of each and the length of the second."""
    for k in range((8 * size).bit_length()):
        if 8 * size >> k & 1:
            first = _applied(_zeros(k), first)
    return first ^ second


DIGESTS = "doc_id long, text_key long, chunk int, chunks int, n_tokens long, n_bytes long, ids_crc32 long, text_crc32 long"


def whole_digests(batches: Batches) -> Batches:
    """Digests of chunks, those of a text in order -> those of the text."""
    for _, rows in itertools.groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["text_key"]):
        whole = next(rows)
        for r in rows:
            whole["ids_crc32"] = crc_of_joined(whole["ids_crc32"], r["ids_crc32"], 4 * r["n_tokens"])
            whole["text_crc32"] = crc_of_joined(whole["text_crc32"], r["text_crc32"], r["n_bytes"])
            whole["n_tokens"] += r["n_tokens"]
            whole["n_bytes"] += r["n_bytes"]
        yield pa.RecordBatch.from_pylist([whole], schema=pa.schema([(c, pa.int32() if c.startswith("chunk") else pa.int64()) for c in whole]))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many chunks and tokens, CRC-32 of the ids (little-endian unsigned 32-bit), and that of the decoded text."""
    e = encoder(table(spark, sf_dir, "documents"))
    to_text = decoded(e.path)

    def digests(batches: Batches) -> Batches:
        for b in to_text(batches):
            raw = [ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for ids in b.column("ids")]
            text = [t.encode("utf-8", "surrogatepass") for t in b.column("decoded").to_pylist()]
            cols = [[len(r) // 4 for r in raw], [len(t) for t in text], [binascii.crc32(r) for r in raw], [binascii.crc32(t) for t in text]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text_key", "chunk", "chunks")), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "text_key", "chunk", "chunks", "n_tokens", "n_bytes", "ids_crc32", "text_crc32"])

    giants = e.giants(digests, DIGESTS).repartition("text_key").sortWithinPartitions("text_key", "chunk").mapInArrow(whole_digests, DIGESTS)
    return e.short(digests, DIGESTS).unionByName(giants).drop("text_key", "chunk")
