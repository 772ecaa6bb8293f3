"""Fitting world coordinates to matched positions: least squares by small sums, refined terms by a tall QR.

The linear part comes from sums over centred coordinates, one aggregate.  With
polynomial terms each partition reduces its rows to a triangle by QR, and the
triangles, of a few columns each, are reduced once more: the tall matrix is never
gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolane.functions.distortion import Sip
from astrolane.functions.projections import projection
from astrolane.operators.celestial import Rotation, centroid, separation
from astrolane.operators.wcs import Wcs
from astrolane.stages import apply, doubles


@dataclass(frozen=True)
class WcsFit:
    wcs: Wcs
    n: int
    rms_arcsec: float
    max_arcsec: float


def _qr(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The R of a QR of the columns, by partitions and then over their triangles."""
    k = len(columns)

    def reduce(frames):
        r = np.zeros((0, k))
        for f in frames:
            r = np.linalg.qr(np.concatenate([r, f[columns].dropna().to_numpy(dtype=float)]), mode="r")
        yield pd.DataFrame(r, columns=columns)

    schema = ", ".join(f"`{c}` double" for c in columns)
    parts = df.select(*columns).mapInPandas(reduce, schema)
    few = parts.repartition(16).mapInPandas(reduce, schema)  # 16 triangles at most reach the driver
    return np.linalg.qr(few.toPandas()[columns].to_numpy(dtype=float), mode="r")


def fit_wcs(df: DataFrame, px: str, py: str, lon: str, lat: str, code: str = "TAN", crval: tuple[float, float] | None = None, crpix: tuple[float, float] | None = None, sip_order: int = 0, frame: str = "equatorial", origin: int = 0, sip_inverse: bool = True) -> WcsFit:
    """The description that maps pixels to positions best. crpix (1-based) pins the reference pixel; sip_order 2 to 9 adds polynomials, with sip_inverse also those of the way back.

    Three rows are needed, two with crpix.
    """
    good = df.select((F.col(px).cast("double") - origin).alias("x"), (F.col(py).cast("double") - origin).alias("y"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).filter("x is not null and y is not null and lon is not null and lat is not null and not isnan(x + y + lon + lat)")
    if crval is None:
        agg, end = centroid("lon", "lat")
        r = apply(good.agg(*(F.expr(doubles(e)).alias(n) for n, e in agg.items())), [end]).first()
        crval = (r["lon"], r["lat"])
    proj = projection(code)
    rot = Rotation.of(crval, proj.theta0)
    plane = apply(good, [*rot.to_native("lon", "lat", "_phi", "_theta"), *proj.forward("_phi", "_theta"), {"xi": "_x", "eta": "_y"}])
    # no filter on what the stages made: pushed through them it would be written out at every step
    ok = ~F.isnan("xi")
    m = plane.agg(F.count(F.when(ok, 1)).alias("n"), *(F.avg(F.when(ok, F.col(c))).alias(c) for c in ("x", "y", "xi", "eta"))).first()
    n = m["n"]
    if n < (2 if crpix else 3):
        raise ValueError(f"{n} positions are too few")
    cx, cy, cxi, ceta = (crpix[0] - 1, crpix[1] - 1, 0.0, 0.0) if crpix else (m["x"], m["y"], m["xi"], m["eta"])
    u, v, a, b = F.col("x") - cx, F.col("y") - cy, F.col("xi") - cxi, F.col("eta") - ceta
    s = plane.agg(*(F.sum(F.when(ok, e)).alias(k) for k, e in {"uu": u * u, "uv": u * v, "vv": v * v, "ua": u * a, "va": v * a, "ub": u * b, "vb": v * b}.items())).first()
    det = s["uu"] * s["vv"] - s["uv"] ** 2
    if abs(det) < 1e-12 * max(s["uu"], s["vv"], 1e-300) ** 2:
        raise ValueError("the positions lie on a line")
    cd = ((s["ua"] * s["vv"] - s["va"] * s["uv"]) / det, (s["va"] * s["uu"] - s["ua"] * s["uv"]) / det), ((s["ub"] * s["vv"] - s["vb"] * s["uv"]) / det, (s["vb"] * s["uu"] - s["ub"] * s["uv"]) / det)
    if crpix is None:  # where the plane's origin falls
        off = np.linalg.solve(np.array(cd), np.array([-cxi, -ceta]))
        crpix = (cx + off[0] + 1, cy + off[1] + 1)
    sip = None
    if sip_order >= 2:
        sip, cd = _fit_sip(plane, crpix, sip_order, sip_inverse)
    prefix = {"equatorial": ("RA--", "DEC-"), "galactic": ("GLON", "GLAT"), "ecliptic": ("ELON", "ELAT")}[frame]
    tail = "-SIP" if sip else ""
    wcs = Wcs((f"{prefix[0]}-{code}{tail}", f"{prefix[1]}-{code}{tail}"), tuple(map(float, crpix)), tuple(map(float, crval)), tuple(tuple(map(float, r)) for r in cd), ("deg", "deg"), sip=sip)
    left = wcs.pixel_to_world(good, ["x", "y"], ["fit_lon", "fit_lat"])
    left = apply(left, separation("fit_lon", "fit_lat", "lon", "lat", "sep"))
    r = left.agg(F.sqrt(F.avg(F.pow(F.col("sep") * 3600, 2))).alias("rms"), F.max(F.col("sep") * 3600).alias("top")).first()
    return WcsFit(wcs, n, r["rms"], r["top"])


def _fit_sip(plane: DataFrame, crpix: tuple[float, float], order: int, inverse: bool):
    """Linear and polynomial terms together; the polynomials are then taken behind the matrix. inverse: what leads back is fitted to the plane behind the inverse matrix."""
    top = plane.agg(F.max(F.abs(F.col("x") - (crpix[0] - 1))).alias("x"), F.max(F.abs(F.col("y") - (crpix[1] - 1))).alias("y")).first()
    k = max(top["x"], top["y"], 1.0)
    powers = [(1, 0), (0, 1)] + [(p, t - p) for t in range(2, order + 1) for p in range(t, -1, -1)]
    scaled = plane.select(((F.col("x") - (crpix[0] - 1)) / k).alias("u"), ((F.col("y") - (crpix[1] - 1)) / k).alias("v"), "xi", "eta")
    names = [f"t{p}_{q}" for p, q in powers]
    tall = scaled.select(*(F.expr(" * ".join(["1.0D", *["u"] * p, *["v"] * q])).alias(n) for n, (p, q) in zip(names, powers, strict=True)), "xi", "eta")
    r = _qr(tall, [*names, "xi", "eta"])
    m = len(names)
    coef = np.linalg.lstsq(r[:, :m], r[:, m:], rcond=None)[0]
    cd = (coef[:2] / k).T
    rest = np.linalg.solve(cd, coef[2:].T)
    scale = [k ** (p + q) for p, q in powers[2:]]
    named = lambda rows: [{pq: float(c / s) for pq, c, s in zip(powers[2:], row, scale, strict=True)} for row in rows]
    if not inverse:
        return Sip(*named(rest)), cd.tolist()
    back = np.linalg.inv(cd) / k
    ideal = scaled.select("u", "v", *((F.lit(float(p)) * F.col("xi") + F.lit(float(q)) * F.col("eta")).alias(n) for n, (p, q) in zip(("iu", "iv"), back, strict=True)))
    tall = ideal.select(*(F.expr(" * ".join(["1.0D", *["iu"] * p, *["iv"] * q])).alias(n) for n, (p, q) in zip(names[2:], powers[2:], strict=True)), (F.col("u") - F.col("iu")).alias("du"), (F.col("v") - F.col("iv")).alias("dv"))
    r, m = _qr(tall, [*names[2:], "du", "dv"]), m - 2
    return Sip(*named(rest), *named(k * np.linalg.lstsq(r[:, :m], r[:, m:], rcond=None)[0].T)), cd.tolist()


def residual_offsets(wcs: Wcs, df: DataFrame, px: str, py: str, lon: str, lat: str) -> DataFrame:
    """df with the offsets of each position, in arc seconds along and across the parallel."""
    out = wcs.pixel_to_world(df, [px, py], ["fit_lon", "fit_lat"])
    return out.withColumns({"dlon": F.expr(f"((({lon} - fit_lon + 180) - 360 * floor(({lon} - fit_lon + 180) / 360)) - 180) * cos(radians({lat})) * 3600"), "dlat": F.expr(f"({lat} - fit_lat) * 3600")}).drop("fit_lon", "fit_lat")


__all__ = ["WcsFit", "fit_wcs", "residual_offsets"]
