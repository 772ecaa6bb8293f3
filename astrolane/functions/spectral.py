"""Spectral axes (Greisen et al. 2006): kinds, non-linear algorithms, air wavelengths and grisms, as SQL expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from astrolane.stages import NAN, PI, Stages, num, when

C = 299792458.0
H = 6.62607015e-34

KINDS = ("FREQ", "ENER", "WAVN", "WAVE", "AWAV", "VRAD", "VOPT", "ZOPT", "VELO", "BETA")
#: The variable in whose terms a kind is linear when no algorithm is given.
ASSOCIATE = {"FREQ": "F", "ENER": "F", "WAVN": "F", "VRAD": "F", "WAVE": "W", "VOPT": "W", "ZOPT": "W", "AWAV": "A", "VELO": "V", "BETA": "V"}
SI = {"FREQ": "Hz", "ENER": "J", "WAVN": "/m", "WAVE": "m", "AWAV": "m", "VRAD": "m/s", "VOPT": "m/s", "ZOPT": "", "VELO": "m/s", "BETA": ""}


def air_index(air: str) -> str:
    """Refractive index of air at the wavelength in air, in metres (Cox 2000)."""
    s2 = f"pow(1e-6 / ({air}), 2)"
    return f"(1 + 1e-6 * (64.328 + 29498.1 / (146 - {s2}) + 255.4 / (41 - {s2})))"


def air_to_vacuum(air: str) -> str:
    return f"({air}) * {air_index(air)}"


def vacuum_to_air(lam: str) -> str:
    """Three fixed-point steps: each one gains five digits."""
    air = lam
    for _ in range(3):
        air = f"(({lam}) / {air_index(air)})"
    return air


def to_freq(kind: str, s: str, rest_freq: float = 0.0, rest_wave: float = 0.0, out: str = "_nu") -> Stages:
    """Frequency in Hz from a value of a kind in SI units; NaN outside its domain."""
    nu0 = rest_freq or (C / rest_wave if rest_wave else 0.0)
    lam0 = rest_wave or (C / rest_freq if rest_freq else 0.0)
    pos = lambda e: [{out: when(f"({s}) > 0", e)}]
    if kind == "FREQ":
        return [{out: f"({s})"}]
    if kind == "ENER":
        return [{out: f"({s}) / {num(H)}"}]
    if kind == "WAVN":
        return [{out: f"({s}) * {num(C)}"}]
    if kind == "WAVE":
        return pos(f"{num(C)} / ({s})")
    if kind == "AWAV":
        return [{"_av": when(f"({s}) > 0", s)}, {out: f"{num(C)} / ({air_to_vacuum('_av')})"}]
    if kind == "VRAD":
        return [{out: f"{num(nu0)} * (1 - ({s}) / {num(C)})"}]
    if kind == "VOPT":
        return [{out: when(f"1 + ({s}) / {num(C)} > 0", f"{num(C / lam0 if lam0 else float('nan'))} / (1 + ({s}) / {num(C)})")}]
    if kind == "ZOPT":
        return [{out: when(f"1 + ({s}) > 0", f"{num(C / lam0 if lam0 else float('nan'))} / (1 + ({s}))")}]
    beta = f"(({s}) / {num(C)})" if kind == "VELO" else f"({s})"
    return [{out: when(f"abs({beta}) < 1", f"{num(nu0)} * sqrt(abs((1 - {beta}) / (1 + {beta})))")}]


def from_freq(kind: str, nu: str, rest_freq: float = 0.0, rest_wave: float = 0.0) -> str:
    """Value of a kind, in SI units, at a frequency in Hz."""
    nu0 = rest_freq or (C / rest_wave if rest_wave else 0.0)
    lam0 = rest_wave or (C / rest_freq if rest_freq else 0.0)
    lam = f"({num(C)} / ({nu}))"
    if kind == "FREQ":
        return f"({nu})"
    if kind == "ENER":
        return f"({nu}) * {num(H)}"
    if kind == "WAVN":
        return f"({nu}) / {num(C)}"
    if kind == "WAVE":
        return when(f"({nu}) > 0", lam)
    if kind == "AWAV":
        return when(f"({nu}) > 0", vacuum_to_air(lam))
    if kind == "VRAD":
        return f"{num(C)} * (1 - ({nu}) / {num(nu0)})"
    if kind == "VOPT":
        return when(f"({nu}) > 0", f"{num(C)} * ({lam} / {num(lam0)} - 1)")
    if kind == "ZOPT":
        return when(f"({nu}) > 0", f"({lam} / {num(lam0)} - 1)")
    f2 = f"pow(({nu}) / {num(nu0)}, 2)"
    beta = f"((1 - {f2}) / (1 + {f2}))"
    return f"{num(C)} * {beta}" if kind == "VELO" else beta


def x_from_freq(x: str, nu: str, nu0: float) -> str:
    """F, W, A or V at a frequency; V is the relativistic velocity."""
    return {"F": f"({nu})", "W": when(f"({nu}) > 0", f"{num(C)} / ({nu})"), "A": when(f"({nu}) > 0", vacuum_to_air(f"({num(C)} / ({nu}))")), "V": from_freq("VELO", nu, nu0)}[x]


def x_to_freq(x: str, value: str, nu0: float, out: str = "_nu") -> Stages:
    return to_freq({"F": "FREQ", "W": "WAVE", "A": "AWAV", "V": "VELO"}[x], value, nu0, 0.0, out)


# the same functions of numbers, for references and slopes that a header fixes

def n_air(air: float) -> float:
    s2 = (1e-6 / air) ** 2
    return 1 + 1e-6 * (64.328 + 29498.1 / (146 - s2) + 255.4 / (41 - s2))


def vac_of_air(air: float) -> float:
    return air * n_air(air)


def air_of_vac(lam: float) -> float:
    air = lam
    for _ in range(20):
        air = lam / n_air(air)
    return air


def f_of(kind: str, s: float, nu0: float, lam0: float) -> float:
    b = s / C if kind == "VELO" else s
    if kind in ("FREQ", "F"):
        return s
    if kind == "ENER":
        return s / H
    if kind == "WAVN":
        return s * C
    if kind in ("WAVE", "W"):
        return C / s
    if kind in ("AWAV", "A"):
        return C / vac_of_air(s)
    if kind == "VRAD":
        return nu0 * (1 - s / C)
    if kind == "VOPT":
        return C / lam0 / (1 + s / C)
    if kind == "ZOPT":
        return C / lam0 / (1 + s)
    if kind == "V":
        b = s / C
    return nu0 * math.sqrt((1 - b) / (1 + b))


def kind_of(kind: str, nu: float, nu0: float, lam0: float) -> float:
    lam = C / nu
    if kind in ("FREQ", "F"):
        return nu
    if kind == "ENER":
        return nu * H
    if kind == "WAVN":
        return nu / C
    if kind in ("WAVE", "W"):
        return lam
    if kind in ("AWAV", "A"):
        return air_of_vac(lam)
    if kind == "VRAD":
        return C * (1 - nu / nu0)
    if kind == "VOPT":
        return C * (lam / lam0 - 1)
    if kind == "ZOPT":
        return lam / lam0 - 1
    f2 = (nu / nu0) ** 2
    b = (1 - f2) / (1 + f2)
    return b if kind == "BETA" else C * b


def slope(y: str, x: str, nu: float, nu0: float, lam0: float) -> float:
    """dY / dX at a frequency, from analytic derivatives with respect to frequency."""

    def dnu(k: str) -> float:  # dK / d nu
        lam = C / nu
        if k in ("FREQ", "F"):
            return 1.0
        if k == "ENER":
            return H
        if k == "WAVN":
            return 1 / C
        dl = -C / nu**2
        if k in ("WAVE", "W"):
            return dl
        if k in ("AWAV", "A"):
            air = air_of_vac(lam)  # lam = n(air) air
            s2 = (1e-6 / air) ** 2
            dn = 1e-6 * (29498.1 / (146 - s2) ** 2 + 255.4 / (41 - s2) ** 2) * -2 * s2 / air
            return dl / (n_air(air) + air * dn)
        if k == "VRAD":
            return -C / nu0
        if k == "VOPT":
            return C * dl / lam0
        if k == "ZOPT":
            return dl / lam0
        f2 = (nu / nu0) ** 2
        db = -4 * nu / nu0**2 / (1 + f2) ** 2
        return db if k == "BETA" else C * db

    return dnu(y) / dnu(x)


@dataclass(frozen=True)
class Grism:
    """PVk_0 to PVk_6: ruling density, order, incidence, index, its slope, epsilon, camera angle."""

    density: float = 0.0
    order: float = 0.0
    alpha: float = 0.0
    n_r: float = 1.0
    n_r_prime: float = 0.0
    epsilon: float = 0.0
    theta: float = 0.0


@dataclass(frozen=True)
class SpectralAxis:
    """One axis: kind, algorithm ("", "LOG", "F2W" ... or "GRI", "GRA"), reference value, rest values, grism."""

    kind: str
    algorithm: str = ""
    crval: float = 0.0
    rest_freq: float = 0.0
    rest_wave: float = 0.0
    grism: Grism | None = None

    @property
    def nu0(self) -> float:
        return self.rest_freq or (C / self.rest_wave if self.rest_wave else 0.0)

    @property
    def lam0(self) -> float:
        return self.rest_wave or (C / self.rest_freq if self.rest_freq else 0.0)

    def forward(self, w: str, out: str) -> Stages:
        """World value from the intermediate coordinate w, both in SI units."""
        s0 = num(self.crval)
        if not self.algorithm:
            return [{out: f"{s0} + ({w})"}]
        if self.algorithm == "LOG":
            return [{out: f"{s0} * exp(({w}) / {s0})"}]
        nu_r = f_of(self.kind, self.crval, self.nu0, self.lam0)
        if self.algorithm in ("GRI", "GRA"):
            g, x = self.grism or Grism(), "W" if self.algorithm == "GRI" else "A"
            lam_r = kind_of(x, nu_r, self.nu0, self.lam0)
            den = g.density * g.order / math.cos(math.radians(g.epsilon)) - g.n_r_prime * math.sin(math.radians(g.alpha))
            base = (g.n_r - g.n_r_prime * lam_r) * math.sin(math.radians(g.alpha))
            gam_r = math.asin(lam_r * den - base)
            dgam = den / (math.cos(gam_r) * math.cos(math.radians(g.theta)) ** 2)
            dx = slope(self.kind, x, nu_r, self.nu0, self.lam0)
            gamma = f"({num(gam_r)} + atan({num(-math.tan(math.radians(g.theta)))} + ({w}) * {num(dgam / dx)}) + {num(math.radians(g.theta))})"
            return [{"_lam": f"(sin({gamma}) + {num(base)}) / {num(den)}"}, *x_to_freq(x, "_lam", self.nu0), {out: from_freq(self.kind, "_nu", self.rest_freq, self.rest_wave)}]
        x = self.algorithm[0]
        x_r = kind_of(x, nu_r, self.nu0, self.lam0)
        return [{"_lin": f"{num(x_r)} + ({w}) / {num(slope(self.kind, x, nu_r, self.nu0, self.lam0))}"}, *x_to_freq(x, "_lin", self.nu0), {out: from_freq(self.kind, "_nu", self.rest_freq, self.rest_wave)}]

    def inverse(self, s: str, out: str) -> Stages:
        """Intermediate coordinate from the world value."""
        s0 = num(self.crval)
        if not self.algorithm:
            return [{out: f"({s}) - {s0}"}]
        if self.algorithm == "LOG":
            return [{out: when(f"({s}) / {s0} > 0", f"{s0} * ln(abs(({s}) / {s0}))")}]
        nu_r = f_of(self.kind, self.crval, self.nu0, self.lam0)
        stages = to_freq(self.kind, s, self.rest_freq, self.rest_wave)
        if self.algorithm in ("GRI", "GRA"):
            g, x = self.grism or Grism(), "W" if self.algorithm == "GRI" else "A"
            lam_r = kind_of(x, nu_r, self.nu0, self.lam0)
            den = g.density * g.order / math.cos(math.radians(g.epsilon)) - g.n_r_prime * math.sin(math.radians(g.alpha))
            base = (g.n_r - g.n_r_prime * lam_r) * math.sin(math.radians(g.alpha))
            gam_r = math.asin(lam_r * den - base)
            dgam = den / (math.cos(gam_r) * math.cos(math.radians(g.theta)) ** 2)
            dx = slope(self.kind, x, nu_r, self.nu0, self.lam0)
            return [*stages, {"_lam": x_from_freq(x, "_nu", self.nu0)}, {"_sg": f"_lam * {num(den)} - {num(base)}"}, {"_gam": when("abs(_sg) <= 1", "asin(greatest(-1e0, least(1e0, _sg)))")}, {out: f"(tan(_gam - {num(gam_r + math.radians(g.theta))}) + {num(math.tan(math.radians(g.theta)))}) / {num(dgam / dx)}"}]
        x = self.algorithm[0]
        x_r = kind_of(x, nu_r, self.nu0, self.lam0)
        return [*stages, {"_lin": x_from_freq(x, "_nu", self.nu0)}, {out: f"(_lin - {num(x_r)}) * {num(slope(self.kind, x, nu_r, self.nu0, self.lam0))}"}]


def parse_ctype(ctype: str) -> tuple[str, str] | None:
    """Kind and algorithm of a CTYPE, or None where it is no spectral axis."""
    kind, rest = ctype[:4].strip().rstrip("-"), ctype[4:].strip("- ").strip()
    if kind not in KINDS or rest == "TAB":
        return None
    if rest in ("", "LOG", "GRI", "GRA") or len(rest) == 3 and rest[1] == "2" and rest[0] in "FWVA" and rest[2] in "FWVA":
        return kind, rest
    return None


__all__ = ["ASSOCIATE", "C", "H", "KINDS", "NAN", "PI", "SI", "Grism", "SpectralAxis", "air_index", "air_to_vacuum", "from_freq", "parse_ctype", "to_freq", "vacuum_to_air"]
