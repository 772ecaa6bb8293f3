"""CHECKSUM and DATASUM: one's-complement sums of 32-bit big-endian words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(total: str) -> str:
    """SQL: the plain sum of words as their one's-complement sum. Sums of parts fold to the same as the sum of all."""
    return f"cast(case when {total} = 0 then 0 else ({total} - 1) - 4294967295 * floor(({total} - 1) / 4294967295) + 1 end as bigint)"


def fold_column(total: Column) -> Column:
    d = total.cast("decimal(38,0)")
    return F.when(d == 0, F.lit(0)).otherwise(F.pmod(d - 1, F.lit(4294967295).cast("decimal(38,0)")) + 1).cast("bigint")


def word_sum(data: bytes, start: int = 0) -> int:
    """One's-complement sum of the words of data, zero-padded, after a partial sum."""
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), dtype=">u4")
    total = int(words.sum(dtype=np.uint64)) + start if len(words) < 1 << 31 else sum(int(words[i : i + (1 << 30)].sum(dtype=np.uint64)) for i in range(0, len(words), 1 << 30)) + start
    return 0 if total == 0 else (total - 1) % 0xFFFFFFFF + 1


def combine(a: int, b: int) -> int:
    """Of two partial sums, whose words lie at multiples of four bytes."""
    return 0 if a + b == 0 else (a + b - 1) % 0xFFFFFFFF + 1


#: ASCII punctuation that the encoding avoids.
_EXCLUDED = frozenset(range(0x3A, 0x41)) | frozenset(range(0x5B, 0x61))


def encode(value: int, complement: bool = True) -> str:
    """The 16 characters of a checksum card: four for each byte, none of them punctuation."""
    value = (0xFFFFFFFF - value) if complement else value
    out = [""] * 16
    for k in range(4):
        byte = value >> (24 - 8 * k) & 255
        q = [byte // 4 + 48] * 4
        q[0] += byte % 4
        while any(c in _EXCLUDED for c in q):  # move pairs apart: the sum stays
            for i in (0, 2):
                if q[i] in _EXCLUDED or q[i + 1] in _EXCLUDED:
                    q[i] += 1
                    q[i + 1] -= 1
        for j in range(4):
            out[4 * j + k] = chr(q[j])
    text = "".join(out)
    return text[-1] + text[:-1]


def decode(text: str, complement: bool = True) -> int:
    """The value that encode stands for."""
    text = text[1:] + text[0]
    value = 0
    for k in range(4):
        value = value << 8 | (sum(ord(text[4 * j + k]) for j in range(4)) - 4 * 48) & 255
    return (0xFFFFFFFF - value) if complement else value


def is_valid(hdu: bytes) -> bool:
    """Whether a whole HDU, with its CHECKSUM card, sums to all ones."""
    return word_sum(hdu) in (0, 0xFFFFFFFF)
