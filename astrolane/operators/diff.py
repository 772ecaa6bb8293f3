"""Differences of frames and files, with tolerances: headers by keyword, cells by position."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolane.sources import container as ct


def is_close(a: str, b: str, rtol: float = 0.0, atol: float = 0.0) -> str:
    """SQL: equal within atol + rtol |b|; NaN equals NaN; infinity is close to itself only."""
    return f"(({a} is null and {b} is null) or (isnan({a}) and isnan({b})) or {a} = {b} or (not isnan({a}) and not isnan({b}) and abs({a}) < double('Infinity') and abs({b}) < double('Infinity') and abs({a} - {b}) <= {atol!r}D + {rtol!r}D * abs({b})))"


def cells(a: DataFrame, b: DataFrame, key: list[str], column: str, rtol: float = 0.0, atol: float = 0.0, most: int = 10) -> DataFrame:
    """The first differences of a column by key, in order, each with the total count.

    The total is counted by a job of its own and the first rows are a top-k of
    each partition, so nothing but `most` rows of the differences is gathered.
    """
    both = a.select(*key, F.col(column).cast("double").alias("a_value")).join(b.select(*key, F.col(column).cast("double").alias("b_value")), key, "full_outer")
    bad = both.filter(~F.expr(is_close("a_value", "b_value", rtol, atol)) | F.col("a_value").isNull() | F.col("b_value").isNull())
    return bad.orderBy(*key).limit(most).withColumn("data_total", F.lit(bad.count()))


def headers(a: DataFrame, b: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """keyword, side or change of the first values of two frames of cards (keyword, vtype, s)."""
    drop = [k.upper() for k in ignore or []]
    first = lambda d, tag: d.filter((F.col("kind") == "value") & ~F.upper("keyword").isin(*drop) if drop else F.col("kind") == "value").groupBy("keyword").agg(F.min_by(F.struct("vtype", F.rtrim("s").alias("s")), "pos").alias(tag))
    joined = first(a, "a").join(first(b, "b"), "keyword", "full_outer")
    return joined.filter(~F.col("a").eqNullSafe(F.col("b"))).select("keyword", F.when(F.col("a").isNull(), "only_in_b").when(F.col("b").isNull(), "only_in_a").otherwise("changed").alias("what"), F.col("a.s").alias("a_value"), F.col("b.s").alias("b_value"))


@dataclass
class HduDiff:
    index: int
    header: list[tuple] = field(default_factory=list)
    data: list[tuple] = field(default_factory=list)
    total: int = 0
    note: str = ""

    @property
    def empty(self) -> bool:
        return not (self.header or self.total or self.note)


@dataclass
class FitsDiff:
    """Two files, unit by unit."""

    hdus: list[HduDiff]
    counts: tuple[int, int]

    @property
    def identical(self) -> bool:
        return self.counts[0] == self.counts[1] and all(h.empty for h in self.hdus)

    def report(self) -> str:
        lines = [f"units: {self.counts[0]} and {self.counts[1]}"] if self.counts[0] != self.counts[1] else []
        for h in self.hdus:
            if not h.empty:
                lines += [f"unit {h.index}: {h.note or f'{len(h.header)} header and {h.total} data differences'}", *(f"  {x}" for x in h.header), *(f"  {x}" for x in h.data)]
        return "\n".join(lines) or "identical"


def close(a, b, rtol: float, atol: float) -> bool:
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(close(x, y, rtol, atol) for x, y in zip(a, b, strict=True))
    if isinstance(a, float) and isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return a == b or math.isfinite(a) and math.isfinite(b) and abs(a - b) <= atol + rtol * abs(b)
    return type(a) is type(b) and (a.rstrip() == b.rstrip() if isinstance(a, str) else a == b)


def files(path_a: str, path_b: str, rtol: float = 0.0, atol: float = 0.0, max_diffs: int = 10, ignore: list[str] | None = None) -> FitsDiff:
    a, b = ct.walk(ct.read_file(path_a)), ct.walk(ct.read_file(path_b))
    drop, out = {k.upper() for k in ignore or []}, []
    for x, y in zip(a, b, strict=False):
        d = HduDiff(x.index)
        out.append(d)
        if x.kind != y.kind:
            d.note = f"{x.kind} and {y.kind}"
            continue
        hx, hy = ({k: v for k, v in u.header.values().items() if k not in drop} for u in (x, y))
        d.header = [(k, hx.get(k), hy.get(k)) for k in sorted(hx) if k not in hy or not close(hx[k], hy[k], 0, 0)] + [(k, None, hy[k]) for k in sorted(hy) if k not in hx]
        if x.raw == y.raw:
            continue
        rows = {"bintable": ct.bintable_rows, "ascii": ct.ascii_rows}.get(x.kind)
        if rows:
            va, vb = list(rows(x)), list(rows(y))
            if len(va) != len(vb) or va and len(va[0]) != len(vb[0]):
                d.note = "tables of different shape"
                continue
            bad = [((r, c), p, q) for r, (ra, rb) in enumerate(zip(va, vb, strict=True)) for c, (p, q) in enumerate(zip(ra, rb, strict=True)) if not close(p, q, rtol, atol)]
        elif x.kind in ("image", "compressed"):
            get = lambda u: ct.physical(u.header, ct.image_raw(u.header, u.raw)) if u.kind == "image" else ct.physical(ct.image_header_of(u.header), ct.decompress(u))
            va, vb = np.asarray(get(x), float), np.asarray(get(y), float)
            if va.shape != vb.shape:
                d.note = "images of different shape"
                continue
            same = np.isclose(va, vb, rtol=rtol, atol=atol, equal_nan=True)
            at = np.flatnonzero(~same.ravel())
            bad = [(int(i), float(va.ravel()[i]), float(vb.ravel()[i])) for i in at[:max_diffs]]
            d.total = len(at)
        else:
            bad = [(i, p, q) for i, (p, q) in enumerate(zip(x.raw, y.raw, strict=False)) if p != q]
        d.total = d.total or len(bad)
        d.data = bad[:max_diffs]
    return FitsDiff(out, (len(a), len(b)))
