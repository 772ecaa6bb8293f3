"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The score of a word is the sum, over all ways to cut it into pieces, of the
product of their probabilities; the forward algorithm gives that sum without
listing the cuts.  The probabilities are learned by expectation maximisation:
forward and backward sums give the expected count of each piece in the training
words of a language; long words, as languages without spaces have them, count
like all others.  A text's score is that of its words, and its language the one of
the greatest posterior.

Words of one Arrow batch that are not known yet are scored together: one step of
the recursion is one array operation over all words of a length.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.llm.common import table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words of so many characters or more are scored alone, with rescaling. In training they are first cut where no piece can cross.
LONG = 40


class Vocabulary:
    """The pieces, by text; index 0 stands for a character that is in none."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.index = {p: k + 1 for k, p in enumerate(plain)}
        self.size = len(plain) + 1
        self.longest = max(map(len, plain))

    def arcs(self, words: list[str]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Of words of one length: the (start, end) pairs, and for each word the piece there, -1 for none.

        A character in no piece is one by itself, index 0.
        """
        n, get, far = len(words[0]), self.index.get, self.longest
        pairs = [(j, i) for i in range(1, n + 1) for j in range(max(0, i - far), i)]
        grid = np.array([[get(w[j:i], -1) for j, i in pairs] for w in words], dtype=np.int32)
        for k, (j, i) in enumerate(pairs):
            if i - j == 1:
                grid[grid[:, k] < 0, k] = 0
        return pairs, grid


def forward(pairs: list[tuple[int, int]], grid: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Sums over segmentations of every prefix: (length + 1, words, languages). prob: pieces x languages, last row 0."""
    n = pairs[-1][1]
    alpha = np.zeros((n + 1, grid.shape[0], prob.shape[1]))
    alpha[0] = 1
    for k, (j, i) in enumerate(pairs):
        if (grid[:, k] >= 0).any():
            alpha[i] += alpha[j] * prob[grid[:, k]]
    return alpha


def backward(pairs: list[tuple[int, int]], grid: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Sums over segmentations of every suffix."""
    n = pairs[-1][1]
    beta = np.zeros((n + 1, grid.shape[0], prob.shape[1]))
    beta[n] = 1
    for k in range(len(pairs) - 1, -1, -1):
        j, i = pairs[k]
        if (grid[:, k] >= 0).any():
            beta[j] += beta[i] * prob[grid[:, k]]
    return beta


def score_long(word: str, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log sum over segmentations of a word of any length, rescaled as it goes."""
    n, get, far = len(word), vocabulary.index.get, vocabulary.longest
    alpha = np.zeros((far + 1, prob.shape[1]))  # of the last positions, in a ring
    alpha[0] = 1
    shift = np.zeros(prob.shape[1])
    for i in range(1, n + 1):
        total = np.zeros(prob.shape[1])
        for j in range(max(0, i - far), i):
            k = get(word[j:i], 0 if i - j == 1 else -1)
            if k >= 0:
                total += alpha[j % (far + 1)] * prob[k]
        alpha[i % (far + 1)] = total
        if i % 8 == 0:
            top = alpha.max(axis=0)
            top[top <= 0] = 1
            alpha /= top
            shift += np.log(top)
    return np.log(np.maximum(alpha[n % (far + 1)], 1e-300)) + shift


def parts_of(word: str, vocabulary: Vocabulary) -> list[str]:
    """The word cut wherever no piece of it can cross: sums over its segmentations are products of the parts' sums."""
    n, index, far = len(word), vocabulary.index, vocabulary.longest
    out, start, reach = [], 0, 0
    for j in range(n):
        if j and reach <= j:
            out.append(word[start:j])
            start = j
        reach = max(reach, next((i for i in range(min(n, j + far), j + 1, -1) if word[j:i] in index), j + 1))
    return [*out, word[start:]]


def expect_long(word: str, vocabulary: Vocabulary, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in a word of any length and the expected count of each, arc by arc; in logs."""
    n, get, far = len(word), vocabulary.index.get, vocabulary.longest
    ends = []  # of each position: where its arcs begin, and their pieces
    for i in range(1, n + 1):
        own = [(j, k) for j in range(max(0, i - far), i) if (k := get(word[j:i], 0 if i - j == 1 else -1)) >= 0]
        ends.append((np.array([j for j, _ in own]), np.array([k for _, k in own])))
    log = np.log(np.maximum(prob, 1e-300))
    alpha = np.full((n + 1, prob.shape[1]), -np.inf)
    beta = alpha.copy()
    alpha[0] = beta[n] = 0
    for i, (j, k) in enumerate(ends, 1):
        alpha[i] = np.logaddexp.reduce(alpha[j] + log[k])
    for i in range(n, 0, -1):
        j, k = ends[i - 1]
        beta[j] = np.logaddexp(beta[j], beta[i] + log[k])
    pieces = np.concatenate([k for _, k in ends])
    return pieces, np.concatenate([np.exp(alpha[j] + log[k] + beta[i] - alpha[n]) for i, (j, k) in enumerate(ends, 1)])


def words_of(text: str) -> list[str]:
    """Lower-case words, each behind the mark."""
    return [MARK + w for w in text.lower().split()]


def by_length(words: list[str], most: int = 4096) -> Iterator[list[str]]:
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for own in groups.values():
        for at in range(0, len(own), most):
            yield own[at : at + most]


class Model:
    """Piece probabilities of each language."""

    def __init__(self, langs: list[str], prob: np.ndarray, prior: np.ndarray):
        self.langs, self.prob, self.prior = langs, prob, prior


def learn(counts: dict[tuple[str, str], int], docs_of: dict[str, int], vocabulary: Vocabulary, rounds: int = 3, smooth: float = 0.05) -> Model:
    """Expectation maximisation from (lang, word) counts; docs_of: documents of each language, for the prior."""
    langs = sorted(docs_of)
    column = {x: k for k, x in enumerate(langs)}
    weight: dict[str, np.ndarray] = {}
    for (lang, word), n in counts.items():
        for part in [word] if len(word) < LONG else parts_of(word, vocabulary):
            weight.setdefault(part, np.zeros(len(langs)))[column[lang]] += n
    groups = [(own, *vocabulary.arcs(own), np.array([weight[w] for w in own])) for own in by_length([w for w in weight if len(w) < LONG])]
    long = [(w, np.flatnonzero(n), n[n > 0]) for w, n in weight.items() if len(w) >= LONG]
    prob = np.full((vocabulary.size + 1, len(langs)), 1 / vocabulary.size)
    prob[-1] = 0  # where there is no piece
    for _ in range(rounds):
        expected = np.zeros_like(prob)
        for _own, pairs, grid, n in groups:
            alpha, beta = forward(pairs, grid, prob), backward(pairs, grid, prob)
            scale = n / np.maximum(alpha[-1], 1e-300)
            for k, (j, i) in enumerate(pairs):
                there = grid[:, k] >= 0
                if there.any():
                    piece = grid[there, k]
                    np.add.at(expected, piece, alpha[j, there] * prob[piece] * beta[i, there] * scale[there])
        for word, own, n in long:
            pieces, times = expect_long(word, vocabulary, prob[:, own])
            np.add.at(expected, (pieces[:, None], own), times * n)
        prob = expected + smooth
        prob[-1] = 0
        prob /= prob.sum(axis=0)
    prior = np.array([docs_of[x] for x in langs], dtype=float)
    return Model(langs, prob, np.log(prior / prior.sum()))


class Scorer:
    """Scores of texts; keeps those of words, in two generations: what is still in use moves on when the younger one is full."""

    def __init__(self, found: Model, vocabulary: Vocabulary, cache: int = 300_000):
        self.found, self.vocabulary, self.cache = found, vocabulary, cache
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, len(found.langs)))
        self.old_row: dict[str, int] = {}
        self.old_rows = self.rows

    def _put(self, words: list[str], scores: np.ndarray) -> None:
        at, need = len(self.row), len(self.row) + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        self.rows[at:need] = scores
        self.row.update(zip(words, range(at, need), strict=True))

    def _add(self, words: list[str]) -> None:
        known = [w for w in words if w in self.old_row]
        if known:
            self._put(known, self.old_rows[[self.old_row[w] for w in known]])
        fresh = [w for w in words if w not in self.old_row]
        for own in by_length([w for w in fresh if len(w) < LONG]):
            pairs, grid = self.vocabulary.arcs(own)
            self._put(own, np.log(np.maximum(forward(pairs, grid, self.found.prob)[-1], 1e-300)))
        for w in fresh:
            if len(w) >= LONG:
                self._put([w], score_long(w, self.vocabulary, self.found.prob)[None])

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its posterior; und and 0 where there is no letter."""
        parts = [words_of(t) if t and any(map(str.isalpha, t)) else None for t in texts]
        row = self.row
        new = list({w for own in parts if own for w in own if w not in row})
        if len(row) + len(new) > self.cache:
            self.old_row, self.old_rows = self.row, self.rows
            self.row, self.rows = {}, np.zeros((1024, self.rows.shape[1]))
            row = self.row
            new = list({w for own in parts if own for w in own})
        self._add(new)
        out = []
        for own in parts:
            if own is None:
                out.append(("und", 0.0))
                continue
            total = self.rows[np.fromiter(map(row.__getitem__, own), dtype=np.int64, count=len(own))].sum(axis=0) + self.found.prior
            total -= total.max()
            p = np.exp(total)
            k = int(p.argmax())
            out.append((self.found.langs[k], float(p[k] / p.sum())))
        return out


_SCORERS: dict[str, Scorer] = {}


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_lang: int = 500, model_path: str | None = None, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from about per_lang documents of each language, drawn by a hash of their text; whole texts, all languages.

    per_lang bounds the training sample: the driver gets the word counts of no more.
    """
    vocabulary = Vocabulary(model_path or public_tokenizers.path(MODEL))
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((vocabulary.size + 1, 0)), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))))
    drawn = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each text as classify() takes them, counted in each batch."""
        for b in batches:
            seen = Counter((lang, w) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) for w in words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    counted = drawn.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = {(r[0], r[1]): r[2] for r in counted.toPandas().itertuples(index=False, name=None)}
    return learn(counts, sizes, vocabulary)


def classify(docs: DataFrame, found: Model, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row. Null texts and texts without a letter are ``und``, score 0.

    Repeated rows get the same; an empty table gives no rows; texts are scored
    whole; columns of other names are not looked at.  Ties go to the first
    language in order.  With no labelled document at all every text is ``und``.
    """
    spark = docs.sparkSession
    path = model_path or public_tokenizers.path(MODEL)
    frame = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = frame.schema["_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(found)  # languages x a fixed vocabulary
    key = uuid.uuid4().hex  # workers outlive a job: no model of an earlier one may be taken for this one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value, Vocabulary(path))
        scorer = _SCORERS[key]
        for b in batches:
            texts = b.column("_text").to_pylist()
            for low in range(0, len(texts), 1000):
                part = texts[low : low + 1000]
                made = scorer.classify(part) if scorer.found.langs else [("und", 0.0)] * len(part)
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(low, len(part)), pa.array([x for x, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())], names=[id_col, "lang_pred", "score"])

    return frame.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = fit(docs.filter(~held_out()))
    out = classify(docs.select("doc_id", "text"), found)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
