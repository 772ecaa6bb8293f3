"""Token counts, the piece codec, packing and language, against the libraries and held-out labels."""

import binascii
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from astrolane.llm import op2_token_counts as op2
from astrolane.llm import op3_piece_codec as op3
from astrolane.llm import op8_language_id as op8
from astrolane.llm import op9_best_fit_packing as op9
from astrolane.llm.pieces import model

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
BYTES = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BITS = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "中", "😀", "▁", "<s>", "0", "1x", "The", "\t", ".", "ñ", "<|endoftext|>", "\x1c", "'s"]
texts = st.lists(st.sampled_from(BITS), max_size=30).map("".join) | st.text(max_size=30)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_prefix_counts_are_the_librarys(text):
    made = op2.PrefixCounter(model(PATH)).counts(text).tolist()
    assert made == [len(LIB.encode(text[:i])) for i in range(len(text) + 1)]


def test_truncation_needs_no_encoding_again():
    text = "Thereretion of the thing, and of the other thing. " * 20
    counts = op2.PrefixCounter(model(PATH)).counts(text)
    for budget in (0, 1, 17, 100, 10_000):
        n = op2.longest_within(counts, budget)
        assert len(LIB.encode(text[:n])) <= budget and all(len(LIB.encode(text[:k])) > budget for k in range(n + 1, min(n + 40, len(text)) + 1))


def test_token_counts(docs, odd, none):
    for frame in (docs, odd):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(LIB.encode(r["text"] or ""))) for r in frame.collect())
        rows = op2.token_counts(frame, prefixes=True).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) and r["prefix_counts"][-1] == r["n_tokens"] for r in rows)
    assert op2.token_counts(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=120).map("".join))
def test_chunks_give_the_librarys_ids(text):
    coder = op3.ChunkCoder(model(PATH))
    ids = np.frombuffer(b"".join(op3.encode_chunks(coder, text, 64)), dtype="<u4").tolist()
    assert ids == LIB.encode(text)


def test_long_runs_and_long_words_are_the_librarys():
    """Blanks without end, and words without end behind blanks: the prefix programme and the chunks, in time."""
    rng = random.Random(8)
    coder, counter = op3.ChunkCoder(model(PATH)), op2.PrefixCounter(model(PATH))
    for text in (" " * 30_000 + "x", "a  b " + "abc" * 40_000, "  " + "x" * 50_000, "a  b" + "".join(rng.choice("abcdefgh") for _ in range(40_000)), "the  cat " * 5000):
        pieces = op3.encode_chunks(coder, text, 4096)
        assert np.frombuffer(b"".join(pieces), dtype="<u4").tolist() == LIB.encode(text) and len(pieces) == -(-(len(text) + 1) // 4096)
        counts = counter.counts(text)
        assert all(counts[k] == len(LIB.encode(text[:k])) for k in (0, 1, 2, 3, 100, 5001, len(text) - 1, len(text)))


def test_checksums_of_joined_bytes():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 5000))
        assert op3.crc_of_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_codec_query_on_giant_texts(spark):
    """Several blocks of chunks; equal to the library's digests."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc de\n") for _ in range(600_000)), "z" * 300_000, "  ".join("word" for _ in range(60_000)), None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {}
    for r in sorted(op3.encode(frame).collect(), key=lambda r: (r["doc_id"], r["chunk"])):
        whole.setdefault(r["doc_id"], []).extend(r["ids"])
    assert whole == {i: LIB.encode(t or "") for i, t in enumerate(texts)}


def test_transfer_matrices_are_associative():
    rng = random.Random(4)
    coder, text = op3.ChunkCoder(model(PATH)), "▁" + "".join(rng.choice("abcdeingthor") for _ in range(600))
    edges = list(range(0, len(text), 100)) + [len(text)]
    m = [coder.matrix(text, a, b, b == len(text)) for a, b in zip(edges, edges[1:], strict=False)]
    left = m[0]
    for x in m[1:]:
        left = op3.product(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = op3.product(x, right)
    assert left == right == {op3.MEET: {op3.MEET: -len(LIB.encode(text[1:].replace("▁", " ")))}}


def test_encode_and_decode(docs, odd, none):
    for frame in (docs, odd):
        for chunk in (64, 16_384):
            rows = op3.decode(op3.encode(frame, chunk=chunk)).collect()
            whole = {}
            for r in sorted(rows, key=lambda r: (r["text_key"], r["chunk"])):
                x = whole.setdefault(r["text_key"], [r["doc_id"], [], ""])
                x[1] += r["ids"]
                x[2] += r["decoded"]
            want = Counter((r["doc_id"], tuple(LIB.encode(r["text"] or "")), r["text"] or "") for r in frame.collect())
            assert Counter((i, tuple(ids), t) for i, ids, t in whole.values()) == want
    assert op3.encode(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(texts)
def test_byte_coder_is_the_library(text):
    coder = CODER
    assert coder.ids(text) == np.array(BYTES.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


CODER = op9.ByteCoder(public_tokenizers.path(op9.MODEL), public_tokenizers.path(op9.RANKS))


def best_fit(lengths, capacity):
    """Sequences that plain best-fit decreasing opens."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_pack_well(seed):
    rng = random.Random(seed)
    capacity = 64
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 12), 33]) for _ in range(400)]
    counts = np.bincount(lengths, minlength=capacity + 1)
    used, seen = {}, Counter()
    for n, rank, some, first, offset in op9.rounds(counts, capacity):
        for k in range(some):
            used.setdefault(first + k, []).append((offset, n))
            seen[n, rank + k] += 1
    assert set(seen.values()) == {1} and len(seen) == len(lengths)
    for rows in used.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) <= best_fit(lengths, capacity) * 1.02 + 1


def test_packing(docs, odd, none):
    for frame, capacity in ((docs, 1024), (odd, 1024), (odd, 7)):
        rows = op9.pack(frame, capacity, 2).collect()
        by_sequence, pieces = {}, Counter()
        for r in rows:
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        for own in by_sequence.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= capacity
        want = Counter()
        for r in frame.collect():
            ids = np.array([*BYTES.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            for k, (a, n) in enumerate(op9.cut(len(ids), capacity)):
                want[r["doc_id"], k, a, n, binascii.crc32(ids[a : a + n].tobytes())] += 1
        assert pieces == want
    assert op9.pack(none).count() == 0


def test_cut():
    assert op9.cut(5, 4) == [(0, 1), (1, 4)] and op9.cut(8, 4) == [(0, 4), (4, 4)] and op9.cut(1, 4) == [(0, 1)]


def segmentations(word, vocabulary):
    if not word:
        return [[]]
    return [[k, *rest] for n in range(1, len(word) + 1) if (k := vocabulary.index.get(word[:n], 0 if n == 1 else None)) is not None for rest in segmentations(word[n:], vocabulary)]


def test_forward_sums_all_segmentations():
    vocabulary = op8.Vocabulary(PATH)
    rng = np.random.default_rng(3)
    prob = np.concatenate([rng.random((vocabulary.size, 2)) / 100, np.zeros((1, 2))])
    for word in ("▁the", "▁zuñ中", "▁ation"):
        want = sum(np.prod(prob[own], axis=0) for own in segmentations(word, vocabulary))
        pairs, grid = vocabulary.arcs([word])
        assert np.allclose(op8.forward(pairs, grid, prob)[-1, 0], want)
        assert np.allclose(op8.backward(pairs, grid, prob)[0, 0], want)
        assert np.allclose(op8.score_long(word, vocabulary, prob), np.log(want))


def test_expected_counts_of_long_words():
    vocabulary = op8.Vocabulary(PATH)
    rng = np.random.default_rng(4)
    prob = np.concatenate([rng.random((vocabulary.size, 2)) / 100, np.zeros((1, 2))])
    for word in ("▁zuñ中", "▁ation", "のthe中国"):
        want = np.zeros_like(prob)
        ways = [(own, np.prod(prob[own], axis=0)) for own in segmentations(word, vocabulary)]
        for own, p in ways:
            for k in own:
                want[k] += p / sum(p for _, p in ways)
        assert "".join(op8.parts_of(word, vocabulary)) == word
        for parts in ([word], op8.parts_of(word, vocabulary)):
            made = np.zeros_like(prob)
            for part in parts:
                np.add.at(made, *op8.expect_long(part, vocabulary, prob))
            assert np.allclose(made, want)


def test_languages_without_spaces(spark):
    """Two of one script, told apart by how often its letters occur, and one of another; the first has most documents."""
    rng = np.random.default_rng(5)
    kana, thai = "のンをスしるトすいイにルたでまて", "ารนอกงมลบยดวสคทต"
    shares = {"aa": (kana, np.arange(1, 17)), "bb": (kana, np.arange(16, 0, -1)), "cc": (thai, np.ones(16))}
    made = [(la, "".join(rng.choice(list(abc), 120, p=w / w.sum()))) for la, n in (("aa", 150), ("bb", 50), ("cc", 50)) for abc, w in [shares[la]] for _ in range(n)]
    made += [("dd", "x" * 3000), ("dd", "http" + "thereisnospaceinthis" * 20)]
    frame = spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(made)], "doc_id long, text string, lang string")
    found = op8.fit(frame.filter("doc_id % 2 = 0 or lang = 'dd'"))
    assert found.langs == ["aa", "bb", "cc", "dd"] and np.isfinite(found.prob).all()
    rows = op8.classify(frame, found).join(frame, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op8.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and all((binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97


def test_language_of_odd_rows(odd, none, docs):
    found = op8.fit(docs)
    rows = op8.classify(odd, found).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert op8.classify(none, found).count() == 0
    assert {r["lang_pred"] for r in op8.classify(odd, op8.fit(none)).collect()} == {"und"}
