"""Section keys: what picks a box of pixels out of an array becomes a filter on pixel columns, which reaches the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def region(key, shape: tuple[int, ...]) -> tuple[list[int], list[int], list[bool]] | None:
    """First index, length and whether it goes, of each axis, slowest first; None for keys that are no plain box.

    Integers, from the end where negative, drop their axis; axes that are not named are whole.
    """
    given = key if isinstance(key, tuple) else (key,)
    if len(given) > len(shape):
        return None
    out = []
    for k, n in zip((*given, *[slice(None)] * (len(shape) - len(given))), shape, strict=True):
        if isinstance(k, int) and not isinstance(k, bool):
            if not -n <= k < n:
                raise IndexError(f"{k} on an axis of {n}")
            out.append((k % n, 1, True))
        elif isinstance(k, slice):
            first, last, step = k.indices(n)
            if step != 1 or last < first:
                return None
            out.append((first, last - first, False))
        else:
            return None
    starts, lengths, gone = map(list, zip(*out, strict=True)) if out else ([], [], [])
    return starts, lengths, gone


def section(pixels: DataFrame, key, shape: tuple[int, ...], columns: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """The pixels in a section; shape and key slowest axis first, columns likewise. Slices with steps and lists of integers are filters too."""
    columns = columns[-len(shape):]
    box = region(key, shape)
    if box is not None:
        for c, first, n in zip(columns, *box[:2], strict=True):
            pixels = pixels.filter((F.col(c) >= first) & (F.col(c) < first + n))
        return pixels
    given = key if isinstance(key, tuple) else (key,)
    if len(given) > len(shape):
        raise IndexError(f"{len(given)} keys for {len(shape)} axes")
    for k, c, n in zip(given, columns, shape, strict=False):
        wanted = range(n)[k] if isinstance(k, slice) else [range(n)[i] for i in (k if isinstance(k, list) else [k])]
        if isinstance(wanted, range):
            low, high = (min(wanted), max(wanted)) if len(wanted) else (0, -1)
            pixels = pixels.filter((F.col(c) >= low) & (F.col(c) <= high) & (F.pmod(F.col(c) - low, F.lit(abs(wanted.step))) == 0))
        else:
            pixels = pixels.filter(F.col(c).isin(wanted))
    return pixels
