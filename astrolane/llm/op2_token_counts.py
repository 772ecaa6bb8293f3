"""Token counts by prefix dynamic programming.

For each text the exact token count of *every* prefix is laid down in one pass:
words are looked up, or run through the dynamic program of ``pieces`` once, and
their prefix counts are strung together.  The array answers how many tokens the
text has, where a budget of tokens runs out, and what any truncation costs,
without encoding anything again.  Counts are not monotone (a merge can make a
longer prefix cheaper), so the cut is the longest prefix within the budget.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.llm.common import table
from astrolane.llm.pieces import MARK, Kept, PieceModel, model

MODEL = "piece_bpe_32k.model"


class PrefixCounter:
    """Prefix counts of texts; keeps those of words, within a bound."""

    def __init__(self, pieces: PieceModel):
        self.kept = Kept(lambda word: array("I", pieces.counts_of(word)).tobytes())

    def counts(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ... text itself."""
        if not text:
            return np.zeros(1, dtype=np.int64)
        own = self.kept.many(MARK + text.replace(" ", MARK))
        flat = np.frombuffer(b"".join(own), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) >> 2
        ends = np.cumsum(sizes)
        totals = flat[ends - 1]
        flat += np.repeat(np.cumsum(totals) - totals, sizes)
        flat[0] = 0  # no text, no mark
        return flat


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of so many tokens at most."""
    return int(np.flatnonzero(counts <= budget)[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def token_counts(docs: DataFrame, limit: int = 4096, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """Id, n_bytes, n_tokens, over_limit, fit_chars, and prefix_counts on request.

    limit: the budget in tokens; fit_chars is the length of the longest prefix
    within it.  prefixes: also return the count of every prefix, the empty one
    first.  Null and empty texts have no tokens; rows that repeat are counted
    alike; an empty table gives no rows; a text of any length is counted whole.
    """
    path = model_path or public_tokenizers.path(MODEL)
    frame = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, PrefixCounter(model(path)))
        for b in batches:
            size, tokens, fit, every = [], [], [], []
            for text in b.column("_text").to_pylist():
                c = counter.counts(text)
                size.append(len(text.encode("utf-8", "surrogatepass")))
                tokens.append(int(c[-1]))
                fit.append(len(text) if c[-1] <= limit else longest_within(c, limit))
                if prefixes:
                    every.append(c)
            made = [pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *made, *([pa.array(every, pa.list_(pa.int64()))] * prefixes)], names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars", *["prefix_counts"] * prefixes])

    kind = frame.schema["_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts array<long>" * prefixes)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), 4096)
