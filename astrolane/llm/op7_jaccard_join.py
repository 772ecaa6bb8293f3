"""N-gram Jaccard join: documents whose shingle sets overlap enough are linked.

1. Each text becomes its set of hashed shingles, named by a 64-bit hash of the
   set; equal sets are one.  A set has an odd bitmap too: as many bits as twice
   its elements or more, each the parity of the elements that fall on it.  The
   bits in which two of them differ are at most the elements in which the sets
   do, so they prove that sets are too far apart.
2. Candidates.  Two sets of similarity t differ in (1 - t) / (1 + t) of their
   summed sizes at most, d elements for the sizes of one interval.  Cut into a
   few more than d parts by hash, they agree in more parts than either has empty
   ones; so a set emits a signature for each part that isn't empty, once for its
   size interval and once for the one below.  A set with too many empty parts is
   cut once more by another hash, as every set is that agrees with it in empty
   parts alone.  No linked pair is missed.
3. Of the sets of a signature, the least one is compared with each other one by
   odd bitmaps; what may be linked forms clusters.  A signature of three sets or
   more that lie in different clusters has all its sets of different clusters
   compared in one task, or in blocks where they are many; what may be linked
   joins clusters.  So two sets of different clusters are not linked, and passages
   that many documents share don't chain clusters.
4. A cluster's exact sets are joined by signature trees, whose nodes hold the OR
   of their sets' bitmaps and a size range; a dual traversal, level by level,
   drops pairs of nodes that can't overlap enough, and sets are compared exactly
   behind the leaves.  A cluster too large for one task is dealt into chunks, each
   with a few sets that all chunks share; then what is not in the component that
   most sets are in meets the whole cluster by pairs of blocks.
5. Components of all links, with the smallest document id as their name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.llm.common import Scratch, table
from astrolane.llm.components import Forest, components

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A new array: the SplitMix64 finaliser of each element."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: A random number for each byte, those of A-Z as for a-z, and an odd one for each place in a word.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_BYTES[65:91] = _BYTES[97:123]
_PLACES = mix(np.arange(1, 1025, dtype=np.uint64) * _ODD[1]) | np.uint64(1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of raw and where they start: sums of a number for each byte times one for its place."""
    b = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[b]
    one = np.ones(1, dtype=np.int8)
    edge = np.diff(np.concatenate([one, space.view(np.int8), one]))
    starts = np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    size = np.flatnonzero(edge == 1) - starts
    first = np.cumsum(size) - size
    places = _PLACES if size.max() <= len(_PLACES) else mix(np.arange(1, size.max() + 1, dtype=np.uint64) * _ODD[1]) | np.uint64(1)
    value = _BYTES[b[~space]]
    value *= places[np.arange(len(value)) - np.repeat(first, size)]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _ODD[2]), starts


class Shingler:
    """Sets of hashed shingles of lower-case (A-Z) words."""

    PORTION = 1 << 20  # bytes that are hashed at once

    def __init__(self, width: int):
        self.width = width

    def set_of(self, text: str | bytes | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer words than the width is one shingle, one without words has none."""
        return next(self.sets([text]))

    def sets(self, texts: list[str | bytes | None]) -> Iterator[np.ndarray]:
        """The set of each text."""
        held, size = [], 0
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass") if not isinstance(t, bytes) else t
            if held and size + len(raw) > self.PORTION:
                yield from self._portion(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw) + 1
        if held:
            yield from self._portion(held)

    def _portion(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        if len(raws) == 1:
            yield self._set(self._words(raws[0]))
            return
        ends = np.cumsum([len(r) + 1 for r in raws])
        words, starts = word_hashes(b"\n".join(raws))
        upto = np.searchsorted(starts, ends)
        shingles = self._shingles(words, self.width) if len(words) >= self.width else words[:0]
        low = 0
        for high in upto.tolist():
            if high - low >= self.width:
                yield _distinct(shingles[low : high - self.width + 1])
            else:
                yield self._set(words[low:high])
            low = high

    def _words(self, raw: bytes) -> np.ndarray:
        """The words of one text of any length, a portion at a time."""
        out, at = [], 0
        while len(raw) - at > self.PORTION and (gap := _GAP.search(raw, at + self.PORTION)):
            out.append(word_hashes(raw[at : gap.start()])[0])
            at = gap.start()
        return np.concatenate([*out, word_hashes(raw[at:])[0]])

    def _set(self, words: np.ndarray) -> np.ndarray:
        return _distinct(self._shingles(words, min(self.width, len(words)))) if len(words) else words

    def _shingles(self, words: np.ndarray, n: int) -> np.ndarray:
        out = np.repeat(_ODD[7:] * np.uint64(n), len(words) - n + 1)
        for k in range(n):
            out = mix(out + words[k : len(words) - n + 1 + k] * _ODD[k % 7])
        return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def odd_bitmap(s: np.ndarray) -> bytes:
    """The parity of the elements on each bit; 64 bits or a power of two of twice the elements or more."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """An odd bitmap of so many 64-bit words from a larger one."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


@dataclass(frozen=True)
class Sizes:
    """Size intervals for similarity num / den, and how many elements may differ."""

    num: int
    den: int

    def interval(self, n: int) -> int:
        """Index of the interval that holds size n, 1 or more."""
        low, k = 1, 0
        while n > (high := low * self.den // self.num):
            low, k = high + 1, k + 1
        return k

    def ends(self, k: int) -> tuple[int, int]:
        low = 1
        for _ in range(k):
            low = low * self.den // self.num + 1
        return low, low * self.den // self.num

    def differ(self, k: int) -> int:
        """Elements that two linked sets may differ in, the smaller of interval k."""
        high = self.ends(k)[1]
        return (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def linked(self, a, b, both):
        """Of sizes and an overlap, or the most it can be; numbers or arrays."""
        return (both > 0) & (self.den * both >= self.num * (a + b - both))

    def apart(self, a, b):
        """Elements that linked sets of these sizes differ in at most, -1 for sizes too far apart."""
        return np.where(self.num * np.maximum(a, b) > self.den * np.minimum(a, b), -1, (a + b) * (self.den - self.num) // (self.den + self.num))


class Signer:
    """Signatures of the parts of a set."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes
        self.schemes: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
        self.intervals: dict[int, int] = {}

    def scheme(self, k: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """How many parts, how many of them agree at least, where they end, and a number for each."""
        if k not in self.schemes:
            d = self.sizes.differ(k)
            parts = d + 2 + d // 12 if d else 1
            number = mix(np.arange(parts, dtype=np.uint64) * _ODD[2] + _ODD[3 : 4] * np.uint64(k + 1))
            self.schemes[k] = parts, parts - d, np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64), number
        return self.schemes[k]

    def sign(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        if len(s) not in self.intervals:
            self.intervals[len(s)] = self.sizes.interval(len(s))
        own = self.intervals[len(s)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + _ODD[1]), dtype=np.uint64)])
        return np.concatenate([x for k in (own, own - 1) if k >= 0 for x in self._cuts(s, sums, k)])

    def _cuts(self, x: np.ndarray, sums: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """The first cut, and more until a part in which a linked set agrees can't be empty.

        Sets have more elements than linked ones differ in, so a cut that fills
        enough parts exists, and each has a fair chance.
        """
        parts, agree, edges, number = self.scheme(k)
        s = x
        for again in itertools.count(1):
            at = np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])
            full = at[1:] > at[:-1]
            yield mix(sums[at[1:]] - sums[at[:-1]] + number)[full]
            if parts - int(full.sum()) < agree:
                return
            x = np.sort(mix(s + _ODD[5 : 6] * np.uint64(again)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x + _ODD[1]), dtype=np.uint64)])
            number = number + _ODD[6]


def bitmap(s: np.ndarray, words: int) -> np.ndarray:
    """A bit for each element, chosen by its upper bits; words: a power of two."""
    out = np.zeros(words, dtype=np.uint64)
    bit = s >> np.uint64(64 - (64 * words - 1).bit_length())
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


class Tree:
    """Levels of nodes over sets in order of size, the leaves first: the OR of bitmaps, least and greatest size, most elements beyond a set's bits."""

    FAN = 4

    def __init__(self, members: np.ndarray, bits: np.ndarray, sizes: np.ndarray):
        self.members = members[np.argsort(sizes[members], kind="stable")]
        own, size = bits[self.members], sizes[self.members]
        spare = size - np.bitwise_count(own).sum(axis=1, dtype=np.int64)
        self.levels = [(own, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), self.FAN)
            b, low, high, more = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    def below(self, level: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes x of a level, and which of x each belongs to."""
        child = (x[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        which = np.repeat(np.arange(len(x)), self.FAN)
        there = child < len(self.levels[level - 1][0])
        return child[there], which[there]


def _pairs_that_may(a: Tree, b: Tree, i: int, j: int, x: np.ndarray, y: np.ndarray, rule: Sizes) -> np.ndarray:
    """Which pairs of nodes, x of level i of a and y of level j of b, may hold linked sets."""
    bits1, low1, high1, more1 = a.levels[i]
    bits2, low2, high2, more2 = b.levels[j]
    ok = np.zeros(len(x), dtype=bool)
    step = max(1, (1 << 20) // bits1.shape[1])
    for at in range(0, len(x), step):
        p, q = x[at : at + step], y[at : at + step]
        most = np.minimum(np.bitwise_count(bits1[p] & bits2[q]).sum(axis=1, dtype=np.int64) + np.minimum(more1[p], more2[q]), np.minimum(high1[p], high2[q]))
        ok[at : at + step] = rule.linked(low1[p], low2[q], most) & (rule.num * np.maximum(low1[p], low2[q]) <= rule.den * np.minimum(high1[p], high2[q]))
    return ok


def dual(a: Tree, b: Tree, rule: Sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that the bitmaps don't tell apart, some at a time; each pair once where a is b."""
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, x, y = stack.pop()
        ok = _pairs_that_may(a, b, i, j, x, y, rule)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if i == j == 0:
            apart = x != y if a is b else slice(None)
            yield a.members[x[apart]], b.members[y[apart]]
            continue
        if i >= j and i:
            x, which = a.below(i, x)
            y, i2, j2 = y[which], i - 1, j
        else:
            y, which = b.below(j, y)
            x, i2, j2 = x[which], i, j - 1
        if a is b:  # of two nodes of one level the first is not behind the other; a level lower, its children may reach up to the other's last
            near = x * Tree.FAN**i2 < (y + 1) * Tree.FAN**j2
            x, y = x[near], y[near]
            if i2 == j2:
                keep = x <= y
                x, y = x[keep], y[keep]
        for at in range(0, len(x), 200_000):
            stack.append((i2, j2, x[at : at + 200_000], y[at : at + 200_000]))


def tree_join(sets: list[np.ndarray], sides: list[int], hub: list[bool], rule: Sizes) -> list[tuple[int, int]]:
    """Links between sets of side 0 and side 1, or among all if there is one side: as many as join the components.

    hub: sets that are one component already.
    """
    sizes = np.array([len(s) for s in sets])
    words = 1 << int(min(128, max(2, 2 * np.median(sizes) / 64)) - 1).bit_length()
    bits = np.array([bitmap(s, words) for s in sets])
    side = np.array(sides)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    comp, links = np.arange(len(sets)), []
    comp[hub := np.array(hub, dtype=bool)] = min(np.flatnonzero(hub), default=0)
    a = Tree(left, bits, sizes)
    b = Tree(right, bits, sizes) if len(right) else a
    # elements of the other side, sorted, with their sets: one search gives a set's exact overlap with all of them
    flat, owner = np.concatenate([sets[j] for j in b.members]), np.repeat(b.members, sizes[b.members])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for xs, ys in dual(a, b, rule):
        if not len(xs):
            continue
        order = np.argsort(xs, kind="stable")
        xs, ys = xs[order], ys[order]
        for at in np.split(np.arange(len(xs)), np.flatnonzero(xs[1:] != xs[:-1]) + 1):
            i, others = int(xs[at[0]]), ys[at]
            others = others[comp[others] != comp[i]]
            if not len(others):
                continue
            if len(others) == 1:
                shared = np.array([len(np.intersect1d(sets[i], sets[others[0]], assume_unique=True))])
            else:
                low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = high - low
                near = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owner[near], minlength=len(sets))[others]
            for j in others[rule.linked(sizes[i], sizes[others], shared)].tolist():
                if comp[i] != comp[j]:
                    comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
                    links.append((i, j))
    return links


def _name(s: np.ndarray) -> int:
    """The signed 64-bit hash that names a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


#: So many sets of an Arrow batch with one signature are dealt over SALTS partitions, for it may be a signature of very many.
DENSE = 16
SALTS = 64


def _named_sets(width: int, kept: list[str]):
    """Texts -> the kept columns, n, node (the set's name, null for no words) and sketch (its odd bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in batches:
            rows = [(len(s), _name(s), odd_bitmap(s)) if len(s) else (0, None, None) for s in shingler.sets(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=[*kept, "n", "node", "sketch"])

    return run


def _signatures(width: int, rule: Sizes):
    """Texts -> (sign, node, salt) once for each signature of a set of a batch.

    Signatures of many sets of a batch are salted, from 1 on; their least set has a row of salt -1 besides, which goes with salt 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(width), Signer(rule)
        for b in batches:
            seen, signs, names = set(), [], []
            held, last = 0, b.num_rows - 1
            for k, s in enumerate(shingler.sets(b.column("text").to_pylist())):
                if len(s) and (name := _name(s)) not in seen:
                    seen.add(name)
                    signs.append(signer.sign(s).view(np.int64))
                    names.append(name)
                    held += len(signs[-1])
                if not signs or held < 1_000_000 and k < last:
                    continue
                sign, node = np.concatenate(signs), np.repeat(np.array(names, dtype=np.int64), [len(x) for x in signs])
                signs, names, held = [], [], 0
                order = np.lexsort((node, sign))
                sign, node = sign[order], node[order]
                head = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
                count = np.diff(np.append(head, len(sign)))
                salt = np.where(np.repeat(count, count) >= DENSE, 1 + node % SALTS, 0)
                least = head[count >= DENSE]
                sign, node, salt = np.append(sign, sign[least]), np.append(node, node[least]), np.append(salt, np.full(len(least), -1))
                for low in range(0, len(sign), 200_000):
                    cut = slice(low, low + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(sign[cut]), pa.array(node[cut]), pa.array(salt[cut].astype(np.int32))], names=["sign", "node", "salt"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by sign, salt and node -> (null, a, b), edges to the least set of a signature, and (sign, a, null), the sets of those that more than two have."""
    held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)] * 2  # sign, node, salt, has given its edge, has been given as a member
    for b in itertools.chain(batches, [None]):
        if b is None:
            sign, node, salt, edged, listed = held
        else:
            new = [b.column(c).to_numpy().astype(np.int64) for c in ("sign", "node", "salt")]
            none = np.zeros(b.num_rows, bool)
            sign, node, salt, edged, listed = (np.concatenate(x) for x in zip(held, [*new, none, none], strict=True))
        if not len(sign):
            continue
        part = np.maximum(salt, 0)
        start = np.concatenate([[True], (sign[1:] != sign[:-1]) | (part[1:] != part[:-1])])
        hot = np.logical_or.reduceat(salt != 0, np.flatnonzero(start))
        once = start | np.concatenate([[True], node[1:] != node[:-1]])
        sign, node, salt, edged, listed, start = (x[once] for x in (sign, node, salt, edged, listed, start))
        head = np.flatnonzero(start)
        count = np.diff(np.append(head, len(sign)))
        many = np.repeat(hot | (count > 2), count)
        first = np.repeat(node[head], count)
        edge = ~edged & (first != node)
        members = many & ~listed
        pairs = np.unique(np.stack([node[edge], first[edge]]), axis=1)
        n, m = pairs.shape[1], int(members.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(n, np.int64), sign[members]), mask=np.arange(n + m) < n), pa.array(np.append(pairs[0], node[members])), pa.array(np.append(pairs[1], np.zeros(m, np.int64)), mask=np.arange(n + m) >= n)], names=["sign", "a", "b"])
        # the last signature may go on in the next batch: three of its rows say all that is needed, and two at most haven't been listed
        at = np.arange(head[-1], len(sign))
        if many[-1]:
            at = np.unique([at[0], at[-min(2, len(at))], at[-1]])
            salt[at[0]] = salt[at[0]] or -1
            listed[at] = True
        held = [sign[at], node[at], salt[at], np.ones(len(at), bool), listed[at]]


def _near(rule: Sizes):
    """Pairs of sets with their odd bitmaps -> the pairs that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = rule.apart(b.column("na").to_numpy(), b.column("nb").to_numpy())
            ok = []
            for d, x, y in zip(most.tolist(), b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                if d >= 0:
                    p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    words = min(len(p), len(q))
                    ok.append(int(np.bitwise_count(fold(p, words) ^ fold(q, words)).sum()) <= d)
                else:
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _meet(rule: Sizes):
    """Sets of a signature, or of two blocks of it -> edges that join those of different labels that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("sign", "x", "y", "own", "node", "label", "n", "sketch")
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        for (_, x, y), rows in itertools.groupby(stream, key=lambda r: r[:3]):
            rows = list(rows)
            words = min(len(r[7]) for r in rows) // 8
            bits = np.array([fold(np.frombuffer(r[7], "<u8"), words) for r in rows])
            own, label, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 5, 6))
            links = []
            for i in np.flatnonzero(own == x).tolist():
                others = np.flatnonzero((own == y) & (label != label[i]))
                if x == y:
                    others = others[others > i]
                most = rule.apart(n[i], n[others])
                others, most = others[most >= 0], most[most >= 0]
                for at in range(0, len(others), 4096):
                    cut = others[at : at + 4096]
                    near = np.bitwise_count(bits[cut] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most[at : at + 4096]
                    for j in cut[near].tolist():
                        if label[j] != label[i]:
                            label[label == label[j]] = label[i]
                            links.append((rows[i][4], rows[j][4]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _exact_sets(width: int):
    """Texts with the name of the set that is meant -> that set, where the text has it; once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, given = Shingler(width), set()
        for b in batches:
            new = [node not in given and not given.add(node) for node in b.column("node").to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            sets = list(shingler.sets(b.column("text").to_pylist()))
            right = pa.array([len(s) > 0 and _name(s) == node for s, node in zip(sets, b.column("node").to_pylist(), strict=True)], pa.bool_())
            kept = ("cluster", "chunks", "c", "node", "n")
            made = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "elements"]).filter(right)
            for low in range(0, made.num_rows, 500):
                yield made.slice(low, 500)

    return run


def _trees(rule: Sizes):
    """Sets of a task, dealt by its key -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("task", "side", "linked", "node", "elements")
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        for _, rows in itertools.groupby(stream, key=lambda r: r[0]):
            rows = list(rows)
            if len(rows) > 1 and any(r[1] == 0 for r in rows):
                links = tree_join([np.frombuffer(r[4], "<u8") for r in rows], [r[1] for r in rows], [r[2] for r in rows], rule)
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][3] for i, _ in links], pa.int64()), pa.array([rows[j][3] for _, j in links], pa.int64())], names=["a", "b"])

    return run


def _candidates(frame: DataFrame, every: DataFrame, width: int, rule: Sizes, scratch: Scratch, paired: int, fits: int) -> tuple[DataFrame, DataFrame]:
    """The clusters (node, label), and node, n, sketch and rep of the sets in candidate pairs."""
    signed = frame.select("text").mapInArrow(_signatures(width, rule), "sign long, node long, salt int").withColumn("part", F.greatest("salt", F.lit(0)))
    met = signed.repartition("sign", "part").sortWithinPartitions("sign", "part", "node").drop("part").mapInArrow(_meetings, "sign long, a long, b long")
    met = scratch.write(met, "met")
    scratch.settle()
    edges = scratch.write(met.filter("sign is null").select("a", "b").distinct(), "edges")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("rep")
    classes = every.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), rep)
    classes = scratch.write(classes.join(nodes, classes["node"] == nodes["a"], "left_semi"), "classes")
    one = lambda k: classes.select(F.col("node").alias(f"node{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    pairs = edges.join(one("a"), F.col("a") == F.col("nodea")).join(one("b"), F.col("b") == F.col("nodeb")).select("a", "b", "na", "nb", "sa", "sb")
    first = components(pairs.mapInArrow(_near(rule), "a long, b long"), scratch, "first", fits)

    # signatures whose sets are in several clusters; of those with the same sets one stays
    name = first.select(F.col("node").alias("named"), "label")
    sets = met.filter("sign is not null").select("sign", F.col("a").alias("node"))
    sets = scratch.write(sets.join(name, sets["node"] == name["named"], "left").select("sign", "node", F.coalesce("label", "node").alias("label")).distinct(), "several")
    unlike = sets.groupBy("sign").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"))
    unlike = scratch.write(unlike.filter("lo < hi").groupBy("c", "x1", "x2").agg(F.min("sign").alias("s")).select("s", F.ceil(F.col("c") / paired).alias("blocks")), "unlike")
    rows = sets.join(unlike, sets["sign"] == unlike["s"]).select("sign", "node", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))
    rows = rows.join(classes.select(F.col("node").alias("of"), "n", "sketch"), F.col("node") == F.col("of"))
    dealt = rows.select("sign", "own", "node", "label", "n", "sketch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    more = dealt.repartition("sign", "x", "y").sortWithinPartitions("sign", "x", "y").mapInArrow(_meet(rule), "a long, b long")
    return components(first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), scratch, "clusters", fits), classes


def _loose(sets: DataFrame, labels: DataFrame, rule: Sizes, scratch: Scratch, block: int, elements: int) -> DataFrame:
    """Tasks (task, side, linked, node, elements) that compare what is not in the main component of a large cluster with all of the cluster."""
    name = labels.select(F.col("node").alias("named"), "label")
    large = sets.filter("chunks > 1").drop("elements")
    large = scratch.write(large.join(name, large["node"] == name["named"], "left").select("cluster", "node", "n", F.coalesce("label", "node").alias("label")).distinct(), "large")
    main = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
    main = scratch.write(main.filter("parts > 1").select(F.col("cluster").alias("of"), "main"), "main")
    left = large.join(main, large["cluster"] == main["of"]).select("cluster", "node", "n", (F.col("label") == F.col("main")).alias("linked")).withColumn("size_class", _interval_column("n", rule))
    counts = left.groupBy("cluster", "linked", "size_class").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / elements)).alias("blocks"))
    counts = scratch.write(counts.select(F.col("cluster").alias("x1"), F.col("linked").alias("x2"), F.col("size_class").alias("x3"), "blocks"), "counts")
    dealt = left.join(counts, (F.col("cluster") == F.col("x1")) & (F.col("linked") == F.col("x2")) & (F.col("size_class") == F.col("x3")))
    dealt = scratch.write(dealt.select("cluster", "node", "linked", "size_class", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("nth")), "dealt")
    blocks = counts.select(F.col("x1").alias("cluster"), F.col("x2").alias("linked"), F.col("x3").alias("size_class"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("nth"))
    a, b = blocks.alias("a"), blocks.alias("b")
    order = lambda t: F.struct(f"{t}.size_class", f"{t}.linked", f"{t}.nth")
    meet = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.abs(F.col("a.size_class") - F.col("b.size_class")) <= 1) & ~(F.col("a.linked") & F.col("b.linked")) & (order("a") <= order("b")))
    parts = ("size_class", "linked", "nth")
    side = lambda t, k: meet.select(F.struct(F.col("a.cluster").alias("cluster"), *(F.col(f"{u}.{c}").alias(f"{u}_{c}") for u in "ab" for c in parts)).alias("task"), F.col("a.cluster").alias("y0"), *(F.col(f"{t}.{c}").alias(f"y{i}") for i, c in enumerate(parts, 1)), F.lit(k).alias("side"), (order("a") == order("b")).alias("same"))
    tasks = scratch.write(side("a", 0).unionByName(side("b", 1).filter("not same")).withColumn("task", F.to_json("task")), "tasks")
    rows = dealt.join(tasks, (F.col("cluster") == F.col("y0")) & (F.col("size_class") == F.col("y1")) & (F.col("linked") == F.col("y2")) & (F.col("nth") == F.col("y3"))).select("task", "side", "linked", F.col("node").alias("r"))
    return rows.join(sets.select("node", "elements"), rows["r"] == F.col("node")).select("task", "side", "linked", "node", "elements")


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, marks: bool = False, hubs: int = 32, elements: int = 1_000_000, paired: int = 4096, fits: int = 500_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; with marks also mark, a hash of its text.

    Texts are linked when den * intersection >= num * union of their sets of
    `width`-word shingles; component_id is the smallest id reachable by links.
    Texts without words, null ones too, are linked with nothing and are their own
    component.  Rows with equal sets are always linked; rows that repeat an id
    are each looked at by their own text; a row without an id takes part, and its
    component's id is null only where no row of the component has one.  Texts of
    any length are taken whole.  An empty table gives no rows; other columns of
    any name are ignored.

    Sizes of tasks, none of them a limit on what is found: block sets or so many
    elements a tree task, hubs sets that all chunks of a large cluster share,
    paired sets of a signature, fits edges.  Shingles and sets go by 64-bit
    hashes, so results are exact but for collisions of those.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    rule = Sizes(num, den)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    every = scratch.write(frame.mapInArrow(_named_sets(width, ["doc_id", "mark"]), "doc_id long, mark long, n long, node long, sketch binary"), "sets")
    clusters, classes = _candidates(frame, every, width, rule, scratch, paired, fits)

    of = clusters.select(F.col("node").alias("of"), F.col("label").alias("cluster"))
    members = scratch.write(classes.drop("sketch").join(of, F.col("node") == F.col("of")).select("cluster", "node", "n", F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark")), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("e")).select(F.col("cluster").alias("of"), "c", F.ceil(F.greatest(F.col("c") / block, F.col("e") / elements)).alias("chunks")).filter("c > 1")
    named = members.join(sizes, members["cluster"] == sizes["of"]).select("cluster", "node", "n", "rep_id", "rep_mark", "c", "chunks")
    # merged at any size: who is in a cluster has no bound
    texts = named.join(frame.hint("merge"), (named["rep_mark"] == frame["mark"]) & named["rep_id"].eqNullSafe(frame["doc_id"])).select("cluster", "chunks", "c", "node", "n", "text")
    sets = scratch.write(texts.mapInArrow(_exact_sets(width), "cluster long, chunks long, c long, node long, n long, elements binary"), "exact")

    own = sets.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    shared = own.filter((F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("c")) < hubs))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).filter("other <> chunk").withColumn("chunk", F.col("other")).drop("other")
    dealt = own.unionByName(shared).select(F.struct("cluster", "chunk").alias("task"), F.lit(0).alias("side"), F.lit(False).alias("linked"), "node", "elements").withColumn("task", F.to_json("task"))
    by_tree = lambda rows: rows.repartition("task").sortWithinPartitions("task").mapInArrow(_trees(rule), "a long, b long")
    links = scratch.write(by_tree(dealt), "links")
    if not sets.filter("chunks > 1").isEmpty():
        loose = by_tree(_loose(sets, components(links, scratch, "chunks", fits), rule, scratch, block, elements))
        links = links.unionByName(loose)
    labels = components(links, scratch, "links", fits)

    ids = every.groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(labels.select(F.col("node").alias("of"), "label"), F.col("node") == F.col("of"), "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    ids = scratch.write(ids.filter("node is not null"), "ids")
    least = ids.groupBy("label").agg(F.min("least").alias("component")).select(F.col("label").alias("l"), "component")
    named = ids.join(least, F.col("label") == F.col("l")).select(F.col("node").alias("set"), "component")
    out = every.join(named, every["node"] == named["set"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), *["mark"] * marks)


def _interval_column(n: str, rule: Sizes):
    """The size interval of a set of n elements, in SQL."""
    ends, low = [], 1
    while low < 1 << 31:
        ends.append(low * rule.den // rule.num)
        low = ends[-1] + 1
    return F.expr(f"cast(size(filter(array({', '.join(f'{e}L' for e in ends)}), e -> e < {n})) as int)")


def drop_near(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, scratch: Scratch | None = None, **sizes: int) -> DataFrame:
    """The rows of docs, columns as they came, less those in the component of a document with a smaller id.

    Where an id repeats with other texts, each row goes or stays by its own.  A row
    without an id stays.
    """
    found = jaccard_components(docs, width, num, den, scratch=scratch, marks=True, **sizes)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.hint("merge").join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_mark"]), "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)
