"""Tile codecs: one tile a call, numpy in, numpy out."""

from __future__ import annotations

import gzip

import numpy as np


class CodecError(ValueError):
    pass


class Bits:
    """Big-endian bits of a byte string, as one integer array of 0 and 1."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise CodecError("the stream ends early")
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | int(b)
        self.at += n
        return v

    def zeros(self) -> int:
        """Zeros up to the next one, which is taken too."""
        ones = self.bits[self.at :]
        n = int(ones.argmax()) if len(ones) else 0
        if not len(ones) or not ones[n]:
            raise CodecError("the stream ends early")
        self.at += n + 1
        return n


#: Bits of the block selector, its largest value, raw bits, by bytes of a pixel.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}


def rice_decode(data: bytes, n: int, size: int = 4, block: int = 32) -> np.ndarray:
    """RICE_1: a first pixel, then blocks of zig-zag differences."""
    selector, top, raw = RICE[size]
    if not n:
        return np.zeros(0, dtype=np.int64)
    s = Bits(data)
    first, out = s.take(8 * size), np.zeros(n, dtype=np.uint64)
    for at in range(0, n, block):
        k = min(block, n - at)
        fs = s.take(selector) - 1
        if fs < 0:
            continue
        if fs == top:
            out[at : at + k] = [s.take(raw) for _ in range(k)]
        else:
            out[at : at + k] = [s.zeros() << fs | (s.take(fs) if fs else 0) for _ in range(k)]
    diff = np.where(out & np.uint64(1), ~(out >> np.uint64(1)), out >> np.uint64(1)).view(np.int64)
    value = (np.cumsum(diff) + first) & ((1 << 8 * size) - 1)
    return value if size == 1 else np.where(value >> (8 * size - 1), value - (1 << 8 * size), value)


def plio_decode(data: bytes, n: int) -> np.ndarray:
    """PLIO_1: run lengths over a current value, in 16-bit words."""
    w = np.frombuffer(data[: len(data) // 2 * 2], dtype=">i2").astype(int)
    if len(w) < 3:
        return np.zeros(n, dtype=np.int64)
    length, at = (int(w[2]), 3) if w[2] > 0 else (int(w[4]) << 15 | int(w[3]), int(w[1]))
    out, x, value = np.zeros(n, dtype=np.int64), 0, 1
    while at < min(length, len(w)):
        op, arg = (int(w[at]) & 0xFFFF) >> 12, int(w[at]) & 0xFFF
        at += 1
        if op == 1:
            if at >= len(w):
                raise CodecError("the stream ends early")
            value, at = int(w[at]) << 12 | arg, at + 1
        elif op in (2, 3):
            value += arg if op == 2 else -arg
        elif op in (6, 7):
            value += arg if op == 6 else -arg
            out[x : x + 1], x = value, x + 1
        elif op == 4:
            out[x : x + arg], x = value, x + arg
        elif op in (0, 5):
            x += arg
            if op == 5:
                out[x - 1 : x] = value
        else:
            raise CodecError(f"opcode {op}")
    return out


#: The prefix code of quadtree nybbles, by bits read.
HUFFMAN = {"000": 1, "001": 2, "010": 4, "011": 8, "1000": 3, "1001": 5, "1010": 10, "1011": 12, "1100": 15, "11010": 6, "11011": 7, "11100": 9, "11101": 11, "11110": 13, "111110": 0, "111111": 14}


def _huffman(s: Bits) -> int:
    key = format(s.take(3), "03b")
    while key not in HUFFMAN:
        key += str(s.take(1))
    return HUFFMAN[key]


def _spread(nybbles: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Each nybble as a 2 x 2 block of bits, cut to size."""
    out = np.zeros((2 * nybbles.shape[0], 2 * nybbles.shape[1]), dtype=np.int64)
    for k, (i, j) in enumerate(((1, 1), (1, 0), (0, 1), (0, 0))):
        out[i::2, j::2] = nybbles >> k & 1
    return out[:rows, :cols]


def _quadtree(s: Bits, rows: int, cols: int, planes: int) -> np.ndarray:
    out = np.zeros((rows, cols), dtype=np.int64)
    depth = max(0, int(np.ceil(np.log2(max(rows, cols, 1)))))
    for bit in range(planes - 1, -1, -1):
        code = s.take(4)
        half = ((rows + 1) // 2, (cols + 1) // 2)
        if code == 0:
            tree = np.array([s.take(4) for _ in range(half[0] * half[1])], dtype=np.int64).reshape(half)
        elif code == 0xF:
            tree = np.array([[_huffman(s)]], dtype=np.int64)
            for k in range(depth - 2, -1, -1):
                step = 1 << k + 1
                bits = _spread(tree, -(-rows // step), -(-cols // step))
                tree = np.array([[_huffman(s) if b else 0 for b in row] for row in bits], dtype=np.int64).reshape(bits.shape)
        else:
            raise CodecError(f"quadtree code {code}")
        out |= _spread(tree, rows, cols) << bit
    return out


def hcompress_decode(data: bytes, smooth: bool = False) -> tuple[np.ndarray, int]:
    """HCOMPRESS_1: the image, rows first, and the scale in its header."""
    if data[:2] != b"\xdd\x99":
        raise CodecError("no HCOMPRESS stream")
    rows, cols, scale = (int.from_bytes(data[2 + 4 * k : 6 + 4 * k], "big", signed=True) for k in range(3))
    total = int.from_bytes(data[14:22], "big", signed=True)
    planes = data[22:25]
    s = Bits(data[25:])
    r2, c2 = (rows + 1) // 2, (cols + 1) // 2
    a = np.zeros((rows, cols), dtype=np.int64)
    a[:r2, :c2] = _quadtree(s, r2, c2, planes[0])
    if cols > c2:
        a[:r2, c2:] = _quadtree(s, r2, cols - c2, planes[1])
    if rows > r2:
        a[r2:, :c2] = _quadtree(s, rows - r2, c2, planes[1])
    if rows > r2 and cols > c2:
        a[r2:, c2:] = _quadtree(s, rows - r2, cols - c2, planes[2])
    if s.take(4):
        raise CodecError("no end mark behind the bit planes")
    s.at = -(-s.at // 8) * 8
    flat = a.ravel()
    for i in np.flatnonzero(flat):
        if s.take(1):
            flat[i] = -flat[i]
    a = flat.reshape(rows, cols)
    a[0, 0] = total
    if scale > 1:
        a *= scale
    return _inverse_h(a, scale if smooth else 0), scale


def _weave(a: np.ndarray, axis: int) -> np.ndarray:
    """The first half at even places, the second at odd ones."""
    n = a.shape[axis]
    out = np.empty_like(a)
    even = [slice(None)] * a.ndim
    odd, lo, hi = list(even), list(even), list(even)
    even[axis], odd[axis], lo[axis], hi[axis] = slice(0, n, 2), slice(1, n, 2), slice(0, (n + 1) // 2), slice((n + 1) // 2, n)
    out[tuple(even)], out[tuple(odd)] = a[tuple(lo)], a[tuple(hi)]
    return out


def _inverse_h(a: np.ndarray, smooth_scale: int = 0) -> np.ndarray:
    """The inverse H-transform: levels from coarse to fine, each on whole arrays; sums carry the bits that rounding dropped."""
    rows, cols = a.shape
    depth = int(np.ceil(np.log2(max(rows, cols)))) if max(rows, cols) > 1 else 0
    if not depth:
        return a

    def to_multiple(v: np.ndarray, unit: int, last: bool = False) -> np.ndarray:
        half = unit >> 1
        return (v + np.where(v >= 0, half, 0 if last else max(half - 1, 0))) & -unit

    unit = 1 << depth - 1
    a[0, 0] = int(to_multiple(np.array(a[0, 0]), unit << 2))
    for level in range(depth - 1, -1, -1):
        r, c, last = -(-rows // (1 << level)), -(-cols // (1 << level)), level == 0
        shift = 2 if last else 1
        part = _weave(_weave(a[:r, :c], 1), 0)
        if smooth_scale > 1:
            _smooth(part, smooth_scale)
        even_r, even_c = r - r % 2, c - c % 2
        h0, hx, hy, hc = (part[i:even_r:2, j:even_c:2].copy() for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)))
        hx, hy, hc = to_multiple(hx, unit << 1), to_multiple(hy, unit << 1), to_multiple(hc, unit, last)
        low0 = hc & unit
        hx, hy = (v - np.where(v >= 0, low0, -low0) for v in (hx, hy))
        low1 = (hc ^ hx ^ hy) & unit << 1
        h0 = np.where(h0 >= 0, h0 + low0 - low1, h0 + np.where(low0 == 0, low1, low0 - low1))
        part[1:even_r:2, 1:even_c:2] = (h0 + hx + hy + hc) >> shift
        part[1:even_r:2, 0:even_c:2] = (h0 + hx - hy - hc) >> shift
        part[0:even_r:2, 1:even_c:2] = (h0 - hx + hy - hc) >> shift
        part[0:even_r:2, 0:even_c:2] = (h0 - hx - hy + hc) >> shift
        if c % 2:  # the last column has no neighbour
            e0, ex = part[0:even_r:2, c - 1].copy(), to_multiple(part[1:even_r:2, c - 1].copy(), unit << 1)
            b = ex & unit << 1
            e0 = np.where(e0 >= 0, e0 - b, e0 + b)
            part[1:even_r:2, c - 1], part[0:even_r:2, c - 1] = (e0 + ex) >> shift, (e0 - ex) >> shift
        if r % 2:  # nor has the last row
            e0, ey = part[r - 1, 0:even_c:2].copy(), to_multiple(part[r - 1, 1:even_c:2].copy(), unit << 1)
            b = ey & unit << 1
            e0 = np.where(e0 >= 0, e0 - b, e0 + b)
            part[r - 1, 1:even_c:2], part[r - 1, 0:even_c:2] = (e0 + ey) >> shift, (e0 - ey) >> shift
            if c % 2:
                part[r - 1, c - 1] >>= shift
        a[:r, :c] = part
        unit >>= 1
    return a


def _smooth(p: np.ndarray, scale: int) -> None:
    """Pulls coefficients toward the slope of their neighbours' sums, within half a quantum."""
    top = scale >> 1
    if top <= 0:
        return
    lim = lambda v, m: np.clip(v, -m, m)
    h = p[0::2, 0::2]
    for axis in (0, 1):
        q = p if axis == 0 else p.T
        hh = h if axis == 0 else h.T
        d = q[1::2, 0::2]
        n = min(d.shape[0], hh.shape[0] - 1)
        if n < 2:
            continue
        prev, mid, nxt = hh[: n - 1], hh[1:n], hh[2 : n + 1]
        diff = nxt - prev
        room = np.maximum(np.minimum(nxt - mid, mid - prev), 0) << 2
        down = np.minimum(np.maximum(nxt - mid, mid - prev), 0) << 2
        s = np.where(diff >= 0, np.minimum(diff, room), np.maximum(diff, down)) - (d[1:n] << 3)
        s = np.where(s >= 0, s >> 3, (s + 7) >> 3)
        d[1:n] += lim(s, top)


def gzip_decode(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else __import__("zlib").decompress(data)


def unshuffle(data: bytes, size: int) -> bytes:
    """GZIP_2: bytes of equal significance lie together."""
    return np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T.tobytes() if size > 1 else data


def dither_table() -> np.ndarray:
    """The 10 000 numbers of the standard generator: x -> 16807 x mod 2^31 - 1."""
    out, seed = np.empty(10_000), 1.0
    for k in range(10_000):
        t = 16807.0 * seed
        seed = t - 2147483647.0 * int(t / 2147483647.0)
        out[k] = seed / 2147483647.0
    return out


_DITHER: list[np.ndarray] = []
ZERO_CODE = -2147483646


def unquantize(q: np.ndarray, scale: float, zero: float, method: str = "NO_DITHER", seed: int = 1, blank: int | None = None) -> np.ndarray:
    """Integers back to reals. seed: ZDITHER0 + tile number, from 0; blanks are NaN and still use up a random number."""
    q = q.astype(np.int64)
    if method == "NO_DITHER":
        out = q * scale + zero
    else:
        if not _DITHER:
            _DITHER.append(dither_table())
        table = _DITHER[0]
        row = (seed - 1) % 10_000
        at, left, parts = int(table[row] * 500), len(q), []
        while left > 0:
            take = min(left, 10_000 - at)
            parts.append(table[at : at + take])
            left -= take
            row = (row + 1) % 10_000
            at = int(table[row] * 500)
        out = (q - np.concatenate(parts or [table[:0]]) + 0.5) * scale + zero
        if method == "SUBTRACTIVE_DITHER_2":
            out = np.where(q == ZERO_CODE, 0.0, out)
    return np.where(q == blank, np.nan, out) if blank is not None else out
