"""-TAB axes: coordinates from lookup arrays, with interpolation.

A table of one dimension is laid down as literals of a search by cases; a table
too long for that is joined by intervals, see ``interval_join``.  Tables of more dimensions are solved by Newton's method over
numpy arrays in ``TabGrid``, one Arrow batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolane.stages import Stages, num, when


def forward_1d(psi: str, index: list[float], values: list[float], out: str) -> Stages:
    """World value at index-vector value psi; half a cell beyond either end is extrapolated, more is NaN."""
    k = len(values)
    up = index[-1] >= index[0]
    lo, hi = (index, values) if up else (index[::-1], values[::-1])
    if k == 1:
        return [{out: when(f"abs(({psi}) - {num(index[0])}) <= 0.5", num(values[0]))}]
    # the segment: how many inner knots are not above psi
    n = " + ".join(f"case when ({psi}) >= {num(x)} then 1 else 0 end" for x in lo[1:-1]) or "0"
    pick = lambda v: "case _seg " + " ".join(f"when {i} then {num(x)}" for i, x in enumerate(v)) + " end"
    return [
        {"_seg": n},
        {"_i0": pick(lo[:-1]), "_i1": pick(lo[1:]), "_v0": pick(hi[:-1]), "_v1": pick(hi[1:])},
        {"_frac": when("_i1 <> _i0", f"(({psi}) - _i0) / (_i1 - _i0)", "0e0")},
        {out: when(f"_frac >= case when _seg = 0 then -0.5 else 0 end and _frac <= case when _seg = {k - 2} then 1.5 else 1 end", "_v0 + _frac * (_v1 - _v0)")},
    ]


def inverse_1d(world: str, index: list[float], values: list[float], out: str) -> Stages:
    """Index-vector value at a world value; values must be monotonic."""
    return forward_1d(world, values, index, out)


def interval_join(df: DataFrame, column: str, table: DataFrame, index: str, value: str, out: str) -> DataFrame:
    """df with the table's interpolated value at df's column, by a range join on neighbouring knots.

    The table is laid out in segments by a window over its rows; it is small by
    nature (one lookup array), and the optimiser broadcasts it where it is.
    """
    w = Window.orderBy(index)
    seg = table.select(F.col(index).alias("_lo"), F.lead(index).over(w).alias("_hi"), F.col(value).alias("_a"), F.lead(value).over(w).alias("_b")).filter("_hi is not null")
    joined = df.join(seg, (F.col(column) >= F.col("_lo")) & (F.col(column) < F.col("_hi")), "left")
    return joined.withColumn(out, F.expr(f"_a + ({column} - _lo) / (_hi - _lo) * (_b - _a)")).drop("_lo", "_hi", "_a", "_b")


@dataclass(frozen=True)
class TabGrid:
    """A lookup array of M dimensions: coords[k_M, ..., k_1, m], and an index vector or None for each."""

    coords: np.ndarray
    index: tuple[np.ndarray | None, ...]

    def _place(self, m: int, psi: np.ndarray) -> np.ndarray:
        """Position along dimension m, 0-based, in cells."""
        knots = self.index[m]
        if knots is None:
            return psi - 1
        knots = np.asarray(knots, dtype=float)
        flip = knots[-1] < knots[0]
        asc = knots[::-1] if flip else knots
        at = np.clip(np.searchsorted(asc, psi, side="right") - 1, 0, max(0, len(asc) - 2))
        pos = at + (psi - asc[at]) / (asc[np.minimum(at + 1, len(asc) - 1)] - asc[at]) if len(asc) > 1 else psi - asc[0]
        return len(asc) - 1 - pos if flip else pos

    def _unplace(self, m: int, pos: np.ndarray) -> np.ndarray:
        knots = self.index[m]
        if knots is None:
            return pos + 1
        knots = np.asarray(knots, dtype=float)
        at = np.clip(np.floor(pos).astype(int), 0, max(0, len(knots) - 2))
        return knots[at] + (pos - at) * (knots[np.minimum(at + 1, len(knots) - 1)] - knots[at])

    def at(self, pos: np.ndarray) -> np.ndarray:
        """Multilinear value at positions (n, M); NaN beyond half a cell outside."""
        n, dims = pos.shape[0], pos.shape[1]
        shape = self.coords.shape[:-1][::-1]
        base = np.stack([np.clip(np.floor(pos[:, m]), 0, max(0, shape[m] - 2)) for m in range(dims)], axis=1).astype(int)
        frac = pos - base
        out = np.zeros((n, self.coords.shape[-1]))
        for corner in range(1 << dims):
            up = [(corner >> m) & 1 for m in range(dims)]
            w = np.prod([frac[:, m] if up[m] else 1 - frac[:, m] for m in range(dims)], axis=0)
            idx = tuple(np.minimum(base[:, m] + up[m], shape[m] - 1) for m in reversed(range(dims)))
            out += w[:, None] * self.coords[idx]
        bad = np.any([(pos[:, m] < -0.5) | (pos[:, m] > shape[m] - 0.5) for m in range(dims)], axis=0)
        out[bad] = np.nan
        return out

    def forward(self, psi: np.ndarray) -> np.ndarray:
        return self.at(np.stack([self._place(m, psi[:, m]) for m in range(psi.shape[1])], axis=1))

    def inverse(self, world: np.ndarray, steps: int = 40) -> np.ndarray:
        """From the nearest grid point on, by Newton steps over the multilinear map."""
        dims = world.shape[1]
        flat = self.coords.reshape(-1, dims)
        start = np.array([int(np.argmin(((flat - w) ** 2).sum(axis=1))) for w in world])
        shape = self.coords.shape[:-1]
        pos = np.stack(np.unravel_index(start, shape), axis=1)[:, ::-1].astype(float)
        top = np.array(shape[::-1]) - 0.5
        for _ in range(steps):
            f = self.at(pos) - world
            jac = np.empty((len(pos), dims, dims))
            for m in range(dims):
                a, b = pos.copy(), pos.copy()
                cell = np.clip(np.floor(pos[:, m]), 0, max(0, shape[::-1][m] - 2))
                a[:, m], b[:, m] = cell, cell + 1
                jac[:, :, m] = self.at(b) - self.at(a)
            step = np.linalg.solve(jac + 1e-300, f[..., None])[..., 0]
            pos = np.clip(pos - step, -0.5, top)
        pos[np.abs(self.at(pos) - world).max(axis=1) > 1e-8 * (1 + np.abs(world).max(axis=1))] = np.nan
        return np.stack([self._unplace(m, pos[:, m]) if not np.isnan(pos[:, m]).any() else np.where(np.isnan(pos[:, m]), np.nan, self._unplace(m, np.nan_to_num(pos[:, m]))) for m in range(dims)], axis=1)

    def transform(self, df: DataFrame, columns: list[str], out: list[str], inverse: bool = False) -> DataFrame:
        """df with the columns out from columns."""
        schema = df.drop(*out).schema
        for c in out:
            schema = schema.add(c, "double")
        run_one = self.inverse if inverse else self.forward

        def run(frames):
            for f in frames:
                made = run_one(f[columns].to_numpy(dtype=float)) if len(f) else np.zeros((0, len(out)))
                yield pd.concat([f.reset_index(drop=True), pd.DataFrame(made, columns=out)], axis=1)

        return df.drop(*out).mapInPandas(run, schema)
