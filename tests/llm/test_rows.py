"""Archives, secrets, dedup, quality, joins and shards, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from astrolane.llm import op1_warc_index as op1
from astrolane.llm import op4_secret_scans as op4
from astrolane.llm import op5_exact_dedup as op5
from astrolane.llm import op6_quality_rules as op6
from astrolane.llm import op7_jaccard_join as op7
from astrolane.llm import op10_sharding as op10
from astrolane.llm.common import Scratch

BODY = "<p>" + "same " * 40 + "</p>"
PAGES = [(1, "http://www.Example.com:8080/a?q=1#x", BODY), (2, "https://example.org/b", BODY), (3, None, BODY), (4, "https://example.org/b", None), (5, "https://example.org/c", "short"), (6, "not an url\nat all", "short"), (7, "https://ex.org/" + "p" * 3000, BODY + "ß"), (7, "https://ex.org/2", "x" * 200), (None, "https://ex.org/3", BODY), (8, "http://[bad", "x" * 200)]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    scratch = Scratch(spark, "t")
    manifest = op1.write_archives(pages, scratch)
    index = op1.build_index(manifest, scratch, block_lines=2)
    assert len(index.keys) >= 5 and max(map(len, index.keys)) <= op1.MAX_KEY
    rows = op1.read_records(op1.lookup(pages, index), scratch, with_payload=True).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        bodies = [(h or "").encode() for i, _, h in PAGES if i == r["page_id"]]
        assert r["payload_digest"] in [hashlib.sha256(b).hexdigest() for b in bodies] and r["payload_bytes"] in map(len, bodies)
        assert r["record_type"] == "revisit" or r["payload"] in bodies
    assert Counter((r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit") == Counter({(2, 1): 1, (3, 1): 1, (None, 1): 1, (8, 7): 1})
    one = spark.createDataFrame([(5, "https://example.org/c"), (5, "https://example.org/none")], "page_id long, url string")
    assert [r["page_id"] for r in op1.read_records(op1.lookup(one, index), scratch).collect()] == [5]


def test_warc_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    index = op1.build_index(op1.write_archives(pages, scratch), scratch)
    assert op1.read_records(op1.lookup(pages, index), scratch).count() == 0


def test_surt():
    assert op1.surt("http://www.Example.com/a?b=c") == "com,example,www)/a?b=c"
    assert len({op1.surt("http://a.b/" + "x" * n) for n in range(300, 400)}) == 100


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


SECRETS = ["token=password: abcdefghijklmnop", "é😀 API_KEY = 'abc.def-ghi=jkl'", "passwd:short passwd:longenough12", "AKIA" + "A" * 13 + " AKIA" + "B" * 14, "AKIAAKIA" + "C" * 10, "0123456789abcdef0 deadbeef", "secret=secret=aaaaaaaaaaaaaa", "apikey=\"x\" api_key:  yyyyyyyyyyyyyyyy", "TOKEN='0123456789abcdef0123456789abcdef'", "0123456789abcdefg" * 3, "", None]


def test_base_spans(spark, odd, docs):
    rng = random.Random(2)
    bits = [*filter(None, SECRETS), " ", "\n", "é", "password=", "AKIA", "deadbeefdeadbeef", ":", "'", "=", "x"]
    texts = SECRETS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for f in (frame, docs, odd):
        for r in op4.scan(f).select("row.doc_id", "row.text", "base", "found").collect():
            assert [tuple(x) for x in r["base"]] == base_spans(r["text"] or "")
            assert set(map(tuple, r["base"])) <= set(map(tuple, r["found"]))
    assert op4.scan(odd.limit(0)).count() == 0


def test_battery_tells_keys_from_words(spark):
    rng = random.Random(7)
    syllables = ["the", "tion", "er", "ing", "an", "re", "on", "at", "en", "nd"]
    words = ["".join(rng.choice(syllables) for _ in range(9))[:24] for _ in range(3000)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(200)]
    names = ["version2versionversion2", "zzzzzzzzzzzzzzzzzzzz1zzzzzzz"] * 20
    frame = spark.createDataFrame([(i, "see " + w + " ok") for i, w in enumerate(words + keys + names)], "doc_id long, text string")
    found = {r["doc_id"]: len(r["found"]) for r in op4.scan(frame).select("row.doc_id", "found").collect()}
    hits = sum(found[i] > 0 for i in range(3000, 3200))
    assert hits > 150 and not any(found[i] for i in range(3000)) and not any(found[i] for i in range(3200, 3240))
    masked = op4.redact(frame.withColumn("n_chars", frame["doc_id"])).filter("doc_id >= 3000 and doc_id < 3200").collect()
    assert sum(r["text"] == "see [SECRET] ok" and r["n_chars"] == 15 for r in masked) == hits


def test_random_keys_by_length(spark):
    """Keys of every length, planted among the tokens of the given table."""
    rng = random.Random(11)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789"]
    keys = [(n, "".join(rng.choice(a) for _ in range(n - 1)) + "7") for a in alphabets for n in (16, 20, 32, 40, 64, 128) for _ in range(100)]
    names = ["version2versionversion2", "en/articles/2021/03/why-cats-sleep", "item-123456789012345"] * 20
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    frame = spark.createDataFrame([("see " + w + " ok",) for w in [k for _, k in keys] + names], "text string").union(docs)
    found = {r["text"]: len(r["found"]) for r in op4.scan(frame).select("row.text", "found").filter("text like 'see % ok'").collect()}
    for n in (16, 20, 32, 40, 64, 128):
        own = [found["see " + k + " ok"] > 0 for m, k in keys if m == n]
        assert sum(own) >= 0.95 * len(own), n
    assert not any(found["see " + w + " ok"] for w in names)


def test_redact(spark):
    frame = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    for r in op4.redact(frame).collect():
        want, at, t = "", 0, SECRETS[r["doc_id"]]
        for a, _, b in base_spans(t or ""):
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["text"] == (None if t is None else want + t[at:])


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("fit", [48 << 20, 300])
def test_exact(spark, odd, docs, none, fit):
    for frame in (odd.repartition(3), docs):
        groups = defaultdict(list)
        rows = frame.collect()
        for r in rows:
            groups[norm(r["text"])].append(r["doc_id"])
        least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
        want = Counter((r["doc_id"], least(groups[k := norm(r["text"])]), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for r in rows)
        got = op5.exact_groups(frame, fit_bytes=fit).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        left = op5.drop_exact(frame, fit_bytes=fit)
        assert left.columns == frame.columns
        assert Counter(r["doc_id"] for r in left.collect()) == Counter(least(v) for v in groups.values())
    assert op5.exact_groups(none).count() == 0 and op5.drop_exact(none).count() == 0


def test_open_table_compares_contents():
    t = op5.OpenTable(8)
    assert [t.find(k, 5) for k in (b"a", b"b", b"a", b"c", b"b")] == [(0, True), (1, True), (0, False), (2, True), (1, False)]


def repeated(words):
    c = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    on = set()
    for i in range(len(words) - 4):
        if c[tuple(words[i : i + 5])] > 1:
            on |= set(range(i, i + 5))
    return len(on)


def test_repeated_words():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert op6.count_repeated(words) == repeated(words)
    many = [b"%d" % (i % 9973) for i in range(25_000)]
    assert op6.count_repeated(many) == len(many)


def test_quality(odd, docs, none):
    for frame in (odd, docs):
        for r in op6.quality(frame).collect():
            t = r["row"]["text"] or ""
            words = re.findall("[^\x20\x09-\x0d]+", t)
            lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            rep = repeated(words)
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
            assert r["base_failed"] == (len(words) < 10 or 100 * rep > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    assert op6.quality(none).count() == 0
    assert op6.clean(odd).columns == odd.columns


def test_lines():
    good = "This is a plain sentence of some words, and it ends well."
    bad = ["home | about | contact | news | login", "### $$$ %%% *** buy now &&&", "BUY THIS NOW FOR FREE TODAY!!", "All rights reserved."]
    fails = lambda x: op6.line_fails(x, len(x.split()), op6.Rules())
    assert not fails(good) and not fails("NASA") and not fails("Hello there") and all(map(fails, bad))
    other = "Another line says something else, at some more length than the first did."
    *_, kept, left, text = op6.judge("\n".join([good, *bad, other]), op6.Rules())
    assert text == good + "\n" + other and left == len(good.split()) + len(other.split()) and kept


def test_menus_go_and_headings_stay():
    menu = ["Home", "About us", "Contact us", "Our products", "", "Careers", "News room", "Site map"]
    *_, kept, left, text = op6.judge("\n".join(menu), op6.Rules())
    assert not kept and left == 0 and not text.strip()
    prose = "This is a plain sentence of some words, and it ends well."
    poem = ["The river bends", "and the willow leans", "over the slow water", "in the evening,", "nobody speaks now.", "The lamp is out."]
    text = "\n".join(["A Heading", prose, "Next Heading", "Its second part", prose, *poem, *["这是一行诗"] * 2, "山高水长", "月落乌啼", "江枫渔火"])
    assert op6.judge(text, op6.Rules())[-1] == text
    assert op6.judge("\n".join([prose, *menu, prose]), op6.Rules())[-1] == "\n".join([prose, "", prose])


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6.op6_quality_rules(spark, sf).collect() if r["doc_id"] in labels]
    assert all(r["kept"] for r in rows if labels[r["doc_id"]] and not r["base_failed"])
    assert sum(not r["kept"] for r in rows if not labels[r["doc_id"]]) > 0.9 * sum(not labels[r["doc_id"]] for r in rows)


def jaccard_brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if not sets[i] or den * len(sets[i]) < num * len(sets[j]):
                if sets[i]:
                    break
                continue
            k = len(sets[i] & sets[j])
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in sets}


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 9, 12, 13, 21, 22, 40, 120]))]
        for _ in range(rng.choice([1, 4, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: -rng.randint(0, max(1, len(w) // 15))] or w
            rows.append((len(rows), " ".join(w)))
    return [*rows, (len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n")]


@pytest.mark.parametrize(("seed", "width", "num", "sizes"), [(5, 3, 90, {}), (6, 3, 90, {"block": 4, "hubs": 1}), (7, 5, 80, {"block": 6, "hubs": 1, "paired": 3, "fits": 10}), (8, 1, 70, {"paired": 2, "fits": 3}), (9, 5, 80, {})])
def test_jaccard(spark, seed, width, num, sizes):
    rows = near_rows(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(frame, width, num, 100, **sizes).collect()}
    assert got == jaccard_brute(rows, width, num, 100)


def test_passages_in_many_texts_lose_no_link(spark):
    """Texts of one passage and words of their own, with near copies among them, in small tasks."""
    rng, rows = random.Random(3), []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 12, 30, 60]))]
        for _ in range(rng.choice([1, 1, 2, 3])):
            w = [*passage, *own]
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for sizes in ({}, {"paired": 16, "block": 16, "hubs": 1}):
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(frame, 5, 80, 100, **sizes).collect()}
        assert got == jaccard_brute(rows, 5, 80, 100)
    kept = {r["doc_id"] for r in op7.drop_near(frame, 5, 80, 100).collect()}
    assert kept == {c for _, _, c in jaccard_brute(rows, 5, 80, 100)}


def test_words_of_any_length_and_portion():
    rng = random.Random(4)
    texts = ["", " \n", "a", "A b", "x" * 5000 + " y z", *(" ".join("w" * rng.randint(1, 9) + str(rng.randrange(50)) for _ in range(rng.randint(1, 400))) for _ in range(60))]
    one = op7.Shingler(3)
    whole = [one.set_of(t) for t in texts]
    small = op7.Shingler(3)
    small.PORTION = 500
    for t, a, b in zip(texts, whole, small.sets(texts), strict=True):
        w = t.lower().split()
        assert len(a) == (len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) if len(w) > 2 else len(w) > 0) and np.array_equal(a, b)


def test_jaccard_of_documents(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(docs).collect()}
    assert got == jaccard_brute(rows, 3, 90, 100)
    assert op7.drop_near(docs).columns == docs.columns


def test_jaccard_of_odd_rows(odd, none):
    rows = Counter((r["doc_id"], r["component_id"]) for r in op7.jaccard_components(odd).collect())
    assert rows == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 1): 2, (None, None): 1, (7, 7): 1, (8, 8): 1, (9, 9): 1})
    assert op7.jaccard_components(none).count() == 0


def test_near_copies_go_by_their_own_text(spark):
    words = [f"w{i}" for i in range(60)]
    same, other = " ".join(words), " ".join(reversed(words))
    frame = spark.createDataFrame([(1, same), (2, same + " "), (2, other), (3, same), (4, None), (None, other)], "doc_id long, text string")
    rows = Counter((r["doc_id"], r["text"]) for r in op7.drop_near(frame).collect())
    assert rows == Counter([(1, same), (2, other), (4, None), (None, other)])


def test_tree_prunes_but_loses_nothing():
    rng = np.random.default_rng(1)
    rule, sets = op7.Sizes(90, 100), []
    for _ in range(20):
        base = rng.integers(0, 2**63, rng.integers(20, 200)).astype(np.uint64)
        sets += [np.unique(base), np.unique(base[: int(len(base) * 0.95)]), np.unique(base[: int(len(base) * 0.86)])]
    union = op7.Forest()
    for i, j in op7.tree_join(sets, [0] * len(sets), [False] * len(sets), rule):
        union.join(i, j)
    want = op7.Forest()
    for i in range(len(sets)):
        for j in range(i):
            if rule.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))):
                want.join(i, j)
    assert [union.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def jump_brute(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = op10.splitmix(np.arange(2000))
    assert op10.jump_hash(keys, 24).tolist() == [jump_brute(int(k), 24) for k in keys]
    a, b = op10.jump_hash(keys, 24), op10.jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and 0.02 < (a != b).mean() < 0.06


def test_shards(odd, docs, none):
    for frame in (odd, docs):
        rows, slots = op10.shard_rows(frame).collect(), defaultdict(list)
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in frame.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert op10.shard_rows(none).count() == 0
