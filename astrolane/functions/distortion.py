"""Plane distortions: SIP, TPV, TNX / ZPX surfaces and Schmidt plates, forward and by Newton steps back."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from astrolane.stages import R, Stages, atan2d, num, when

Terms = dict[tuple[int, int], float]


def poly2(u: str, v: str, terms: Terms) -> str:
    """Sum of c u^p v^q, by Horner's rule in both; zero terms leave no trace."""
    terms = {k: c for k, c in terms.items() if c}
    if not terms:
        return "0e0"
    top = max(p for p, _ in terms)
    rows = []
    for p in range(top + 1):
        qs = {q: c for (pp, q), c in terms.items() if pp == p}
        row = "0e0"
        for q in range(max(qs, default=-1), -1, -1):
            row = num(qs.get(q, 0.0)) if row == "0e0" else f"({num(qs.get(q, 0.0))} + {v} * {row})"
        rows.append(row)
    out = rows[-1]
    for row in reversed(rows[:-1]):
        out = f"({row} + {u} * {out})"
    return out


def d_du(terms: Terms) -> Terms:
    return {(p - 1, q): p * c for (p, q), c in terms.items() if p}


def d_dv(terms: Terms) -> Terms:
    return {(p, q - 1): q * c for (p, q), c in terms.items() if q}


def newton2(f: str, g: str, fu: str, fv: str, gu: str, gv: str, u: str, v: str, steps: int) -> Stages:
    """Stages that solve f = g = 0 from the columns u and v on; a singular step stays put, what has not converged is NaN.

    The six expressions are over u and v.
    """
    out: Stages = []
    for _ in range(steps):
        out += [{"_nf": f, "_ng": g, "_fu": fu, "_fv": fv, "_gu": gu, "_gv": gv}, {"_det": "_fu * _gv - _fv * _gu"}, {u: when("abs(_det) > 1e-15", f"{u} - (_nf * _gv - _ng * _fv) / _det", u), v: when("abs(_det) > 1e-15", f"{v} - (_ng * _fu - _nf * _gu) / _det", v)}]
    return [*out, {"_nf": f, "_ng": g}, {"_ok": f"abs(_nf) + abs(_ng) < 1e-9 * (1 + abs({u}) + abs({v}))"}, {u: when("_ok", u), v: when("_ok", v)}]


@dataclass(frozen=True)
class Sip:
    """u' = u + A(u, v), v' = v + B(u, v), in pixels from CRPIX."""

    a: Terms
    b: Terms
    ap: Terms = field(default_factory=dict)
    bp: Terms = field(default_factory=dict)

    def forward(self, u: str, v: str, out_u: str, out_v: str) -> Stages:
        return [{"_su": poly2(u, v, self.a), "_sv": poly2(u, v, self.b)}, {out_u: f"({u}) + _su", out_v: f"({v}) + _sv"}]

    def inverse(self, u: str, v: str, out_u: str, out_v: str, steps: int = 6) -> Stages:
        seed = [{out_u: f"({u}) + {poly2(u, v, self.ap)}", out_v: f"({v}) + {poly2(u, v, self.bp)}"}]
        p = lambda t: poly2(out_u, out_v, t)
        return seed + newton2(f"{out_u} + {p(self.a)} - ({u})", f"{out_v} + {p(self.b)} - ({v})", f"1 + {p(d_du(self.a))}", p(d_dv(self.a)), p(d_du(self.b)), f"1 + {p(d_dv(self.b))}", out_u, out_v, steps)


#: Registry numbers of the radial terms, r to r^7.
RADIAL = {3: 1, 11: 3, 23: 5, 39: 7}


def tpv_terms(coeffs: dict[int, float]) -> tuple[Terms, dict[int, float]]:
    """Monomials and radial powers of a TPV axis: degrees 0 to 7 in order, each odd one closed by a radial term."""
    terms, radial, k = {}, {}, 0
    for degree in range(8):
        for q in range(degree + 1):
            terms[degree - q, q] = k
            k += 1
        if degree % 2:
            radial[degree] = k
            k += 1
    c = {1: 1.0} | coeffs
    return {pq: c.get(i, 0.0) for pq, i in terms.items()}, {n: c.get(i, 0.0) for n, i in radial.items() if c.get(i)}


@dataclass(frozen=True)
class Tpv:
    """Polynomials of the plane coordinates, 40 terms an axis; the second axis takes (y, x)."""

    pv1: dict[int, float]
    pv2: dict[int, float]

    def _eval(self, which: dict[int, float], x: str, y: str) -> tuple[str, str, str]:
        """Value and derivatives with respect to x and y."""
        terms, radial = tpv_terms(which)
        r2 = f"({x} * {x} + {y} * {y})"
        val = " + ".join([poly2(x, y, terms), *(f"{num(c)} * pow({r2}, {num(n / 2)})" for n, c in radial.items())])
        dr = " + ".join(f"{num(c * n)} * case when {r2} > 0 then pow({r2}, {num(n / 2 - 1)}) else 0e0 end" for n, c in radial.items()) or "0e0"
        return f"({val})", f"({poly2(x, y, d_du(terms))} + ({dr}) * {x})", f"({poly2(x, y, d_dv(terms))} + ({dr}) * {y})"

    def forward(self, x: str, y: str, out_x: str, out_y: str) -> Stages:
        return [{"_tx": self._eval(self.pv1, x, y)[0], "_ty": self._eval(self.pv2, y, x)[0]}, {out_x: "_tx", out_y: "_ty"}]

    def inverse(self, x: str, y: str, out_x: str, out_y: str, steps: int = 8) -> Stages:
        f, fx, fy = self._eval(self.pv1, out_x, out_y)
        g, gy, gx = self._eval(self.pv2, out_y, out_x)
        return [{"_wx": x, "_wy": y}, {out_x: "_wx", out_y: "_wy"}, *newton2(f"{f} - _wx", f"{g} - _wy", fx, fy, gx, gy, out_x, out_y, steps)]


def reassemble_wat(cards: dict[str, str], axis: int) -> str:
    """The text of WATj_nnn, whose pieces are 68 characters each."""
    keys = sorted(k for k in cards if re.fullmatch(rf"WAT{axis}_\d{{3}}", k))
    return "".join(str(cards[k]).ljust(68) if k != keys[-1] else str(cards[k]) for k in keys)


@dataclass(frozen=True)
class Surface:
    """A TNX / ZPX surface: function type, orders, cross terms, ranges and coefficients."""

    function: int  # 1 Chebyshev, 2 Legendre, 3 polynomial
    ni: int
    nj: int
    cross: int  # 0 none, 1 full, 2 half
    ranges: tuple[float, float, float, float]
    coeffs: tuple[float, ...]

    @classmethod
    def parse(cls, text: str) -> Surface:
        v = [float(x) for x in text.split()]
        return cls(round(v[0]), round(v[1]), round(v[2]), round(v[3]), tuple(v[4:8]), tuple(v[8:]))

    def pairs(self) -> list[tuple[int, int]]:
        """Orders (i, j) in the order of the coefficients."""
        out = []
        for j in range(self.nj):
            top = self.ni if self.cross == 1 or j == 0 else 1 if self.cross == 0 else max(0, min(self.ni, max(self.ni, self.nj) - j))
            out += [(i, j) for i in range(top)]
        return out

    def terms(self) -> Terms:
        """As a polynomial in the plane coordinates themselves: bases and scales multiplied out."""
        lo_x, hi_x, lo_y, hi_y = self.ranges
        scale = (lambda lo, hi: (0.0, 1.0)) if self.function == 3 else (lambda lo, hi: (-(hi + lo) / (hi - lo), 2 / (hi - lo)))
        bx, by = self._basis(self.ni, *scale(lo_x, hi_x)), self._basis(self.nj, *scale(lo_y, hi_y))
        out: Terms = {}
        for c, (i, j) in zip(self.coeffs, self.pairs(), strict=False):
            for p, a in enumerate(bx[i]):
                for q, b in enumerate(by[j]):
                    out[p, q] = out.get((p, q), 0.0) + c * a * b
        return out

    def _basis(self, n: int, shift: float, factor: float) -> list[list[float]]:
        """Coefficients, in the raw variable, of the first n basis functions of shift + factor * x."""

        def times_t(p: list[float]) -> list[float]:
            out = [0.0] * (len(p) + 1)
            for k, c in enumerate(p):
                out[k] += shift * c
                out[k + 1] += factor * c
            return out

        polys = [[1.0], [shift, factor]]
        while len(polys) < n:
            k = len(polys)
            up, back = times_t(polys[-1]), polys[-2]
            a, b = {1: (2.0, 1.0), 2: ((2 * k - 1) / k, (k - 1) / k), 3: (1.0, 0.0)}[self.function]
            polys.append([a * c - b * (back[i] if i < len(back) else 0.0) for i, c in enumerate(up)])
        return polys[:n]


@dataclass(frozen=True)
class Tnx:
    """x + lngcor(x, y), y + latcor(x, y)."""

    lng: Surface | None
    lat: Surface | None

    @classmethod
    def from_wat(cls, lon_text: str, lat_text: str) -> Tnx:
        get = lambda key, t: (m := re.search(rf'{key}\s*=\s*"([^"]*)"', t)) and Surface.parse(m[1])
        return cls(get("lngcor", lon_text), get("latcor", lat_text))

    def _sip(self) -> Sip:
        return Sip(self.lng.terms() if self.lng else {}, self.lat.terms() if self.lat else {})

    def forward(self, x: str, y: str, out_x: str, out_y: str) -> Stages:
        return self._sip().forward(x, y, out_x, out_y)

    def inverse(self, x: str, y: str, out_x: str, out_y: str, steps: int = 8) -> Stages:
        return [{"_wx": x, "_wy": y}, *self._sip().inverse("_wx", "_wy", out_x, out_y, steps)]


@dataclass(frozen=True)
class Dss:
    """A digitised Schmidt plate: 13 plate constants an axis, centre, pixel sizes, corner."""

    ra: float
    dec: float
    ppo3: float
    ppo6: float
    xpixelsz: float
    ypixelsz: float
    cnpix1: float
    cnpix2: float
    amdx: tuple[float, ...]
    amdy: tuple[float, ...]

    @staticmethod
    def _terms(amd: tuple[float, ...]) -> Terms:
        """Plate constants 1 to 13: 7 multiplies x^2 + y^2, 12 and 13 x (x^2 + y^2) and x (x^2 + y^2)^2."""
        c = [*amd, *[0.0] * 13][:13]
        t: Terms = {(1, 0): c[0], (0, 1): c[1], (0, 0): c[2], (2, 0): c[3] + c[6], (1, 1): c[4], (0, 2): c[5] + c[6], (3, 0): c[7] + c[11], (2, 1): c[8], (1, 2): c[9] + c[11], (0, 3): c[10]}
        for pq, k in (((5, 0), 1), ((3, 2), 2), ((1, 4), 1)):
            t[pq] = t.get(pq, 0.0) + k * c[12]
        return t

    def forward(self, px: str, py: str, lon: str, lat: str) -> Stages:
        """From 1-based pixels to the sky; the second polynomial takes (y, x)."""
        a, b = self._terms(self.amdx), self._terms(self.amdy)
        cd, sd = math.cos(math.radians(self.dec)), math.sin(math.radians(self.dec))
        return [
            {"_mx": f"({num(self.ppo3)} - {num(self.xpixelsz)} * (({px}) + {num(self.cnpix1 - 0.5)})) / 1000", "_my": f"({num(self.ypixelsz)} * (({py}) + {num(self.cnpix2 - 0.5)}) - {num(self.ppo6)}) / 1000"},
            {"_xi": f"{num(1 / 3600 / R)} * {poly2('_mx', '_my', a)}", "_eta": f"{num(1 / 3600 / R)} * {poly2('_my', '_mx', b)}"},
            {"_den": f"{num(cd)} - _eta * {num(sd)}"},
            {"_dra": atan2d("_xi", "_den")},
            {lon: f"(({num(self.ra)} + _dra) - 360 * floor(({num(self.ra)} + _dra) / 360))", lat: atan2d(f"_eta * {num(cd)} + {num(sd)}", "sqrt(_xi * _xi + _den * _den)")},
        ]

    def inverse(self, lon: str, lat: str, px: str, py: str, steps: int = 8) -> Stages:
        a, b = self._terms(self.amdx), self._terms(self.amdy)
        cd, sd = math.cos(math.radians(self.dec)), math.sin(math.radians(self.dec))
        swap = lambda t: {(q, p): c for (p, q), c in t.items()}
        bb, s = swap(b), num(3600 * R)
        start = 1 / (a.get((1, 0), 1.0) or 1.0), 1 / (b.get((1, 0), 1.0) or 1.0)
        p = lambda t: poly2("_mx", "_my", t)
        return [
            {"_da": f"radians(({lon}) - {num(self.ra)})", "_de": f"radians({lat})"},
            {"_den": f"sin(_de) * {num(sd)} + cos(_de) * {num(cd)} * cos(_da)"},
            {"_sx": when("_den > 0", f"{s} * cos(_de) * sin(_da) / _den"), "_sy": when("_den > 0", f"{s} * (sin(_de) * {num(cd)} - cos(_de) * {num(sd)} * cos(_da)) / _den")},
            {"_mx": f"_sx * {num(start[0])}", "_my": f"_sy * {num(start[1])}"},
            *newton2(f"{p(a)} - _sx", f"{p(bb)} - _sy", p(d_du(a)), p(d_dv(a)), p(d_du(bb)), p(d_dv(bb)), "_mx", "_my", steps),
            {px: f"({num(self.ppo3)} - 1000 * _mx) / {num(self.xpixelsz)} - {num(self.cnpix1 - 0.5)}", py: f"({num(self.ppo6)} + 1000 * _my) / {num(self.ypixelsz)} - {num(self.cnpix2 - 0.5)}"},
        ]
