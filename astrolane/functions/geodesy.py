"""WGS84 positions of observatories, as SQL expressions."""

from __future__ import annotations

from astrolane.stages import Stages, atan2d, cosd, num, sind

#: The WGS84 ellipsoid.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
EP2 = E2 / (1 - E2)


def geodetic_to_ecef(lon: str, lat: str, h: str, x: str = "x", y: str = "y", z: str = "z") -> Stages:
    return [{"_n": f"{num(A)} / sqrt(1 - {num(E2)} * pow({sind(lat)}, 2))"}, {x: f"(_n + ({h})) * {cosd(lat)} * {cosd(lon)}", y: f"(_n + ({h})) * {cosd(lat)} * {sind(lon)}", z: f"(_n * {num(1 - E2)} + ({h})) * {sind(lat)}"}]


def ecef_to_geodetic(x: str, y: str, z: str, lon: str = "lon", lat: str = "lat", h: str = "h") -> Stages:
    """Bowring's single step."""
    return [
        {"_p": f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"},
        {"_u": f"atan2(({z}) * {num(A)}, _p * {num(B)})"},
        {"_lat": f"atan2(({z}) + {num(EP2 * B)} * pow(sin(_u), 3), _p - {num(E2 * A)} * pow(cos(_u), 3))"},
        {"_n": f"{num(A)} / sqrt(1 - {num(E2)} * pow(sin(_lat), 2))"},
        {lon: atan2d(y, x), lat: "degrees(_lat)", h: f"case when _p > 1 then _p / cos(_lat) - _n else abs({z}) - {num(B)} end"},
    ]
