"""Native and celestial coordinates: the pole from header values, rotations as stages, great circles, centroids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from astrolane.stages import Stages, atan2d, cosd, num, sind, wrap180, wrap360


@dataclass(frozen=True)
class Rotation:
    """Celestial position of the native pole, and its native longitude."""

    alpha_p: float
    delta_p: float
    phi_p: float

    @classmethod
    def of(cls, crval: tuple[float, float], theta0: float, lonpole: float | None = None, latpole: float | None = None, phi0: float = 0.0) -> Rotation:
        """From the fiducial point. Of two poles the one nearer LATPOLE (90 by default) is taken."""
        a0, d0 = crval
        phi_p = lonpole if lonpole is not None else phi0 + (0.0 if d0 >= theta0 else 180.0)
        if theta0 == 90:
            return cls(a0, d0, phi_p)
        r = math.radians
        t0, pp, dd = r(theta0), r(phi_p - phi0), r(d0)
        base = math.atan2(math.sin(t0), math.cos(t0) * math.cos(pp))
        q = math.sqrt(max(0.0, 1 - (math.cos(t0) * math.sin(pp)) ** 2))
        if q < 1e-10:
            if abs(d0) > 1e-10:
                raise ValueError("no native pole fits CRVAL and LONPOLE")
            dp = 90.0 if latpole is None else latpole
        else:
            z = math.sin(dd) / q
            if abs(z) > 1 + 1e-10:
                raise ValueError("no native pole fits CRVAL and LONPOLE")
            turn = math.acos(max(-1.0, min(1.0, z)))
            norm = lambda x: (math.degrees(x) + 180) % 360 - 180
            ok = [x for x in (norm(base + turn), norm(base - turn)) if abs(x) <= 90 + 1e-9]
            if not ok:
                raise ValueError("no native pole fits CRVAL and LONPOLE")
            want = 90.0 if latpole is None else latpole
            dp = max(-90.0, min(90.0, min(reversed(ok), key=lambda x: round(abs(x - want), 12)) if len(ok) > 1 and abs(abs(ok[0] - want) - abs(ok[1] - want)) < 1e-12 else min(ok, key=lambda x: abs(x - want))))
        if abs(abs(d0) - 90) < 1e-10:
            ap = a0
        elif abs(dp - 90) < 1e-6:
            ap = a0 + phi_p - phi0 - 180
        elif abs(dp + 90) < 1e-6:
            ap = a0 - phi_p + phi0
        else:
            y = math.sin(pp) * math.cos(t0) / math.cos(dd)
            x = (math.sin(t0) - math.sin(r(dp)) * math.sin(dd)) / (math.cos(r(dp)) * math.cos(dd))
            ap = a0 - math.degrees(math.atan2(y, x))
        return cls(ap % 360, dp, phi_p)

    def to_sky(self, phi: str, theta: str, lon: str, lat: str) -> Stages:
        return [*rotate(phi, theta, self.phi_p, self.delta_p, "_rl", "_rb"), {lon: wrap360(f"{num(self.alpha_p)} + _rl"), lat: "_rb"}]

    def to_native(self, lon: str, lat: str, phi: str, theta: str) -> Stages:
        return [*rotate(lon, lat, self.alpha_p, self.delta_p, "_rl", "_rb"), {phi: wrap180(f"{num(self.phi_p)} + _rl"), theta: "_rb"}]


def rotate(lon: str, lat: str, lon_p: float, lat_p: float, out_lon: str, out_lat: str) -> Stages:
    """Spherical rotation with the pole at (lon_p, lat_p): the new longitude, from the pole's meridian, and latitude."""
    s, c = num(math.sin(math.radians(lat_p))), num(math.cos(math.radians(lat_p)))
    return [
        {"_sb": sind(lat), "_cb": cosd(lat), "_sd": sind(f"({lon}) - {num(lon_p)}"), "_cd": cosd(f"({lon}) - {num(lon_p)}")},
        {"_ux": f"_sb * {c} - _cb * {s} * _cd", "_uy": "-_cb * _sd", "_uz": f"_sb * {s} + _cb * {c} * _cd"},
        # near the poles the latitude comes from the distance to the axis
        {out_lon: "case when _ux = 0 and _uy = 0 then 0e0 else degrees(atan2(_uy, _ux)) end", out_lat: "case when isnan(_uz) then _uz when abs(_uz) > 0.99 then sign(_uz) * degrees(acos(least(1e0, sqrt(_ux * _ux + _uy * _uy)))) else degrees(asin(_uz)) end"},
    ]


def separation(lon1: str, lat1: str, lon2: str, lat2: str, out: str) -> Stages:
    """Great-circle distance in degrees (haversines)."""
    return [{"_hv": f"pow({sind(f'(({lat2}) - ({lat1})) / 2')}, 2) + {cosd(lat1)} * {cosd(lat2)} * pow({sind(f'(({lon2}) - ({lon1})) / 2')}, 2)"}, {out: "2 * degrees(asin(sqrt(least(1e0, _hv))))"}]


def centroid(lon: str, lat: str) -> tuple[dict[str, str], dict[str, str]]:
    """Aggregates of unit vectors, and the position they point to."""
    return (
        {"_vx": f"sum({cosd(lat)} * {cosd(lon)})", "_vy": f"sum({cosd(lat)} * {sind(lon)})", "_vz": f"sum({sind(lat)})"},
        {"lon": wrap360(atan2d("_vy", "_vx")), "lat": atan2d("_vz", "sqrt(_vx * _vx + _vy * _vy)")},
    )
