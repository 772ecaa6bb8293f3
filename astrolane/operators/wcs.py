"""World coordinates: header to transform and back, pixel to world and world to pixel as stages over columns.

Everything that a header fixes (matrices, poles, slopes) is worked out on the
driver and becomes literals; what is left is a chain of stages over the pixel or
world columns, so a frame of any size is one scan with generated code.  Pixels are
0-based.  A point outside a transform's domain is NaN; the others are not touched.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolane.functions import spectral as sp
from astrolane.functions import tabular
from astrolane.functions.distortion import Dss, Sip, Tnx, Tpv, reassemble_wat
from astrolane.functions.projections import CODES, Projection, projection
from astrolane.functions.units import parse_unit
from astrolane.operators.celestial import Rotation, separation
from astrolane.stages import Stages, apply, num

TIME_SCALES = ("UTC", "GMT", "UT1", "TAI", "IAT", "TT", "TDT", "ET", "TDB", "TCG", "TCB", "GPS", "LOCAL")


@dataclass(frozen=True)
class Tab:
    """The lookup arrays of one -TAB axis of one dimension."""

    index: tuple[float, ...]
    values: tuple[float, ...]


@dataclass(frozen=True)
class Wcs:
    """An immutable description. matrix: CD, or PC with CDELT multiplied in, row by row."""

    ctype: tuple[str, ...]
    crpix: tuple[float, ...]
    crval: tuple[float, ...]
    matrix: tuple[tuple[float, ...], ...]
    cunit: tuple[str, ...] = ()
    pv: dict[tuple[int, int], float] = field(default_factory=dict)
    lonpole: float | None = None
    latpole: float | None = None
    shape: tuple[int, ...] = ()
    sip: Sip | None = None
    tnx: Tnx | None = None
    dss: Dss | None = None
    tab: dict[int, Tab] = field(default_factory=dict)
    rest_freq: float = 0.0
    rest_wave: float = 0.0
    alt: str = " "
    radesys: str | None = None
    equinox: float | None = None

    # -- from and to headers

    @classmethod
    def from_header(cls, h: dict, alt: str = " ", tab: dict[int, Tab] | None = None) -> Wcs:
        """From keyword values; alt: the alternate, blank or A to Z. PC and CD exclude each other; CROTA is the old form."""
        a = alt.strip()
        get = lambda k, d=None: h.get(k + a, d)
        n = int(get("WCSAXES", h.get("WCSDIM", h.get("NAXIS", 0))) or 0)
        n = max([n, *(int(m[1]) for k in h if (m := re.fullmatch(rf"CTYPE(\d+){a}", k)))])
        axes = range(1, n + 1)
        pc = {(i, j): float(h[k]) for i in axes for j in axes if (k := f"PC{i}_{j}{a}") in h}
        cd = {(i, j): float(h[k]) for i in axes for j in axes if (k := f"CD{i}_{j}{a}") in h}
        if pc and cd:
            raise ValueError("PC and CD in one header")
        cdelt = [float(get(f"CDELT{i}", 1.0)) for i in axes]
        ctype = tuple(str(get(f"CTYPE{i}", "") or "").strip() for i in axes)
        if cd:
            m = [[cd.get((i, j), 0.0) for j in axes] for i in axes]
        elif pc:
            m = [[cdelt[i - 1] * pc.get((i, j), float(i == j)) for j in axes] for i in axes]
        else:
            m = [[cdelt[i - 1] * (i == j) for j in axes] for i in axes]
            pair = _pair(ctype)
            rho = float(get(f"CROTA{pair[1] + 1}", get(f"CROTA{pair[0] + 1}", 0.0)) or 0.0) if pair else 0.0
            if rho:
                lon, lat = pair
                c, s, ratio = math.cos(math.radians(rho)), math.sin(math.radians(rho)), cdelt[lat] / cdelt[lon]
                m[lon][lon], m[lon][lat] = cdelt[lon] * c, -cdelt[lon] * s * ratio
                m[lat][lon], m[lat][lat] = cdelt[lat] * s / ratio, cdelt[lat] * c
        crpix = [float(get(f"CRPIX{j}", 0.0)) for j in axes]
        m, crpix = _with_ltm(h, m, crpix, n)
        pv = {(int(x[1]), int(x[2])): float(v) for k, v in h.items() if (x := re.fullmatch(rf"PV(\d+)_(\d+){a}", k))}
        sip = None
        if any(t.endswith("-SIP") for t in ctype) or "A_ORDER" in h and not a:
            t = lambda name: {(int(x[1]), int(x[2])): float(v) for k, v in h.items() if (x := re.fullmatch(rf"{name}_(\d+)_(\d+)", k))}
            sip = Sip(t("A"), t("B"), t("AP"), t("BP"))
        tnx = None
        if (p := _pair(ctype)) and ctype[p[0]][5:8] in ("TNX", "ZPX"):
            tnx = Tnx.from_wat(reassemble_wat(h, p[0] + 1), reassemble_wat(h, p[1] + 1))
        dss = None
        if "AMDX1" in h and "PPO3" in h and not a:
            f = lambda k, d=0.0: float(h.get(k, d))
            ra = 15 * (f("PLTRAH") + f("PLTRAM") / 60 + f("PLTRAS") / 3600)
            dec = (-1 if str(h.get("PLTDECSN", "+")).strip() == "-" else 1) * (f("PLTDECD") + f("PLTDECM") / 60 + f("PLTDECS") / 3600)
            dss = Dss(ra, dec, f("PPO3"), f("PPO6"), f("XPIXELSZ"), f("YPIXELSZ"), f("CNPIX1"), f("CNPIX2"), tuple(f(f"AMDX{k}") for k in range(1, 14)), tuple(f(f"AMDY{k}") for k in range(1, 14)))
            if not ctype or not ctype[0]:
                ctype = ("RA---TAN", "DEC--TAN")
        opt = lambda k: float(v) if (v := get(k)) is not None else None
        return cls(
            ctype, tuple(crpix), tuple(float(get(f"CRVAL{i}", 0.0)) for i in axes), tuple(map(tuple, m)), tuple(str(get(f"CUNIT{i}", "") or "").strip() for i in axes), pv,
            opt("LONPOLE"), opt("LATPOLE"), tuple(int(h[f"NAXIS{i}"]) for i in axes if f"NAXIS{i}" in h), sip, tnx, dss, dict(tab or {}),
            float(get("RESTFRQ", h.get("RESTFREQ", 0.0)) or 0.0), float(get("RESTWAV", 0.0) or 0.0), alt, str(r).strip() if (r := get("RADESYS", h.get("RADECSYS"))) else None, opt("EQUINOX"),
        )

    def to_header(self) -> dict:
        """Keyword values that from_header reads back to an equal description: the CD form, always with the pole."""
        a, out = self.alt.strip(), {}
        n = self.naxis
        out["WCSAXES" + a] = n
        for i in range(n):
            out[f"NAXIS{i + 1}"] = self.shape[i] if i < len(self.shape) else 0
        for i in range(n):
            out |= {f"CTYPE{i + 1}{a}": self.ctype[i], f"CRPIX{i + 1}{a}": self.crpix[i], f"CRVAL{i + 1}{a}": self.crval[i]}
            if i < len(self.cunit) and self.cunit[i]:
                out[f"CUNIT{i + 1}{a}"] = self.cunit[i]
            out |= {f"CD{i + 1}_{j + 1}{a}": self.matrix[i][j] for j in range(n)}
        out |= {f"PV{i}_{m}{a}": v for (i, m), v in self.pv.items()}
        if self.celestial is not None:
            r = self.rotation()
            out["LONPOLE" + a] = r.phi_p if self.lonpole is None else self.lonpole
            out["LATPOLE" + a] = r.delta_p if self.latpole is None else self.latpole
        if self.sip:
            for name, t in (("A", self.sip.a), ("B", self.sip.b), ("AP", self.sip.ap), ("BP", self.sip.bp)):
                if t:
                    out[f"{name}_ORDER"] = max(p + q for p, q in t)
                    out |= {f"{name}_{p}_{q}": c for (p, q), c in t.items()}
        for k, v in (("RESTFRQ", self.rest_freq), ("RESTWAV", self.rest_wave), ("RADESYS", self.radesys), ("EQUINOX", self.equinox)):
            if v:
                out[k + a] = v
        return out

    # -- what the axes are

    @property
    def naxis(self) -> int:
        return len(self.ctype)

    @property
    def celestial(self) -> tuple[int, int] | None:
        """Longitude and latitude axis, from 0."""
        return _pair(self.ctype)

    def axis_kind(self, i: int) -> str:
        """longitude, latitude, spectral, time, phase, stokes or linear."""
        t = self.ctype[i].upper()
        if (p := self.celestial) and i in p:
            return "longitude" if i == p[0] else "latitude"
        base = t[:4].strip().rstrip("-")
        if base in sp.KINDS:
            return "spectral"
        if t == "STOKES":
            return "stokes"
        if t == "PHASE":
            return "phase"
        if re.sub(r"\(.*", "", t).strip() in (*TIME_SCALES, "TIME", "UT"):
            return "time"
        return "linear"

    def axis_kinds(self) -> list[str]:
        return [self.axis_kind(i) for i in range(self.naxis)]

    @property
    def is_celestial(self) -> bool:
        return self.celestial is not None

    @property
    def is_tabular(self) -> bool:
        return any(t.endswith("-TAB") for t in self.ctype)

    def projection(self) -> Projection:
        lon, lat = self.celestial
        code = self.ctype[lon][5:8]
        own = {m: v for (i, m), v in self.pv.items() if i == lat + 1} if code not in ("TPV", "TNX") else {}
        return projection(code, own)

    def fiducial(self) -> tuple[float, float, float, float]:
        """Native coordinates of the reference point, and its plane offset."""
        proj, (lon, _) = self.projection(), self.celestial
        moved = {m: v for (i, m), v in self.pv.items() if i == lon + 1} if self.ctype[lon][5:8] != "TPV" else {}
        if 1 in moved or 2 in moved:
            phi0, theta0 = moved.get(1, 0.0), moved.get(2, proj.theta0)
            if moved.get(0):
                x0, y0 = evaluate(proj.forward("phi", "theta"), {"phi": phi0, "theta": theta0}, ("_x", "_y"))
                return phi0, theta0, x0, y0
            return phi0, theta0, 0.0, 0.0
        return 0.0, proj.theta0, 0.0, 0.0

    def rotation(self) -> Rotation:
        lon, lat = self.celestial
        moved = {m: v for (i, m), v in self.pv.items() if i == lon + 1} if self.ctype[lon][5:8] != "TPV" else {}
        phi0, theta0, _, _ = self.fiducial()
        lonpole = self.lonpole if self.lonpole is not None else moved.get(3)
        latpole = self.latpole if self.latpole is not None else moved.get(4)
        f = self._scale(lon), self._scale(lat)
        return Rotation.of((self.crval[lon] * f[0], self.crval[lat] * f[1]), theta0, lonpole, latpole, phi0)

    def _scale(self, i: int) -> float:
        """Degrees in the axis's unit."""
        u = self.cunit[i] if i < len(self.cunit) else ""
        return parse_unit(u).factor_to(parse_unit("deg")) if u and u != "deg" else 1.0

    def _spectral(self, i: int) -> tuple[sp.SpectralAxis, float] | None:
        found = sp.parse_ctype(self.ctype[i].upper())
        if not found:
            return None
        u = self.cunit[i] if i < len(self.cunit) else ""
        si = sp.SI[found[0]]
        k = parse_unit(u).factor_to(parse_unit(si)) if u and si else 1.0
        own = {m: v for (ax, m), v in self.pv.items() if ax == i + 1}
        g = sp.Grism(*(own.get(m, d) for m, d in enumerate((0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)))) if found[1] in ("GRI", "GRA") else None
        return sp.SpectralAxis(found[0], found[1], self.crval[i] * k, self.rest_freq, self.rest_wave, g), k

    # -- transforms

    def forward(self, pixels: list[str], out: list[str]) -> Stages:
        """Stages from 0-based pixel columns to world columns."""
        n, stages = self.naxis, [{f"_d{j}": f"({pixels[j]}) + 1 - {num(self.crpix[j])}" for j in range(self.naxis)}]
        pair = self.celestial
        if self.sip and pair:
            lon, lat = pair
            stages += self.sip.forward(f"_d{lon}", f"_d{lat}", f"_d{lon}", f"_d{lat}")
        stages.append({f"_w{i}": " + ".join(f"{num(c)} * _d{j}" for j, c in enumerate(self.matrix[i]) if c) or "0e0" for i in range(n)})
        stages.append({out[i]: f"{num(self.crval[i])} + _w{i}" for i in range(n)})
        for i in range(n):
            if s := self._spectral(i):
                axis, k = s
                if axis.algorithm:
                    stages += [*axis.forward(f"_w{i} * {num(k)}", "_sv"), {out[i]: f"_sv / {num(k)}"}]
            elif i in self.tab:
                stages += tabular.forward_1d(f"{num(self.crval[i])} + _w{i}", list(self.tab[i].index), list(self.tab[i].values), out[i])
        if pair and self.dss:
            return stages + self.dss.forward(f"({pixels[pair[0]]}) + 1", f"({pixels[pair[1]]}) + 1", out[pair[0]], out[pair[1]])
        if pair:
            lon, lat = pair
            proj, rot = self.projection(), self.rotation()
            _, _, x0, y0 = self.fiducial()
            stages.append({"_px": f"_w{lon} * {num(self._scale(lon))}", "_py": f"_w{lat} * {num(self._scale(lat))}"})
            if self.ctype[lon][5:8] == "TPV":
                stages += self._tpv().forward("_px", "_py", "_px", "_py")
            if self.tnx:
                stages += self.tnx.forward("_px", "_py", "_px", "_py")
            stages += proj.inverse(f"(_px + {num(x0)})" if x0 else "_px", f"(_py + {num(y0)})" if y0 else "_py")
            stages += rot.to_sky("_phi", "_theta", "_lon", "_lat")
            stages.append({out[lon]: f"_lon / {num(self._scale(lon))}", out[lat]: f"_lat / {num(self._scale(lat))}"})
        return stages

    def inverse(self, world: list[str], out: list[str]) -> Stages:
        """Stages from world columns to 0-based pixel columns."""
        n, pair = self.naxis, self.celestial
        inv = np.linalg.inv(np.array(self.matrix, dtype=float)) if n else np.zeros((0, 0))
        stages: Stages = [{f"_w{i}": f"({world[i]}) - {num(self.crval[i])}" for i in range(n)}]
        for i in range(n):
            if s := self._spectral(i):
                axis, k = s
                if axis.algorithm:
                    stages += [*axis.inverse(f"({world[i]}) * {num(k)}", "_sv"), {f"_w{i}": f"_sv / {num(k)}"}]
            elif i in self.tab:
                stages += [*tabular.inverse_1d(f"({world[i]})", list(self.tab[i].index), list(self.tab[i].values), "_tv"), {f"_w{i}": f"_tv - {num(self.crval[i])}"}]
        if pair and not self.dss:
            lon, lat = pair
            proj, rot = self.projection(), self.rotation()
            _, _, x0, y0 = self.fiducial()
            stages += rot.to_native(f"({world[lon]}) * {num(self._scale(lon))}", f"({world[lat]}) * {num(self._scale(lat))}", "_phi", "_theta")
            stages += proj.forward("_phi", "_theta")
            stages.append({"_px": f"_x - {num(x0)}", "_py": f"_y - {num(y0)}"})
            if self.tnx:
                stages += [*self.tnx.inverse("_px", "_py", "_qx", "_qy"), {"_px": "_qx", "_py": "_qy"}]
            if self.ctype[lon][5:8] == "TPV":
                stages += [*self._tpv().inverse("_px", "_py", "_qx", "_qy"), {"_px": "_qx", "_py": "_qy"}]
            stages.append({f"_w{lon}": f"_px / {num(self._scale(lon))}", f"_w{lat}": f"_py / {num(self._scale(lat))}"})
        stages.append({f"_d{j}": " + ".join(f"{num(inv[j][i])} * _w{i}" for i in range(n) if inv[j][i]) or "0e0" for j in range(n)})
        if self.sip and pair:
            lon, lat = pair
            stages += [*self.sip.inverse(f"_d{lon}", f"_d{lat}", "_qu", "_qv"), {f"_d{lon}": "_qu", f"_d{lat}": "_qv"}]
        stages.append({out[j]: f"_d{j} + {num(self.crpix[j])} - 1" for j in range(n)})
        if pair and self.dss:
            stages += [*self.dss.inverse(world[pair[0]], world[pair[1]], "_p1", "_p2"), {out[pair[0]]: "_p1 - 1", out[pair[1]]: "_p2 - 1"}]
        return stages

    def _tpv(self) -> Tpv:
        lon, lat = self.celestial
        own = lambda i: {m: v for (ax, m), v in self.pv.items() if ax == i + 1}
        return Tpv(own(lon), own(lat))

    def pixel_to_world(self, df: DataFrame, pixels: list[str], out: list[str], origin: int = 0) -> DataFrame:
        """df with world columns; origin: the first pixel's number."""
        return apply(df, self.forward([f"({p}) - {origin}" if origin else p for p in pixels], out))

    def world_to_pixel(self, df: DataFrame, world: list[str], out: list[str], origin: int = 0) -> DataFrame:
        df = apply(df, self.inverse(world, out))
        return df.withColumns({c: F.col(c) + origin for c in out}) if origin else df

    def footprint_stages(self, corner: str, out: list[str]) -> Stages:
        """World coordinates of corner number `corner` (0, 1, ... in Gray order) of the image; other axes sit at CRPIX."""
        if len(self.shape) < 2:
            raise ValueError("no image size")
        gray = f"(({corner}) + case when ({corner}) in (2) then 1 when ({corner}) in (3) then -1 else 0 end)"
        px = {f"_c{j}": f"case when floor({gray} / {num(2**j)}) % 2 = 1 then {num(self.shape[j] - 1)} else 0e0 end" for j in range(2)}
        px |= {f"_c{j}": num(self.crpix[j] - 1) for j in range(2, self.naxis)}
        return [px, *self.forward([f"_c{j}" for j in range(self.naxis)], out)]

    def scale_stages(self, pixels: list[str], out_x: str, out_y: str) -> Stages:
        """Arc seconds to the next pixel along each celestial axis."""
        lon, lat = self.celestial
        n, stages = self.naxis, []
        for tag, move in (("a", None), ("b", lon), ("c", lat)):
            stages += self.forward([f"({p}) + 1" if j == move else p for j, p in enumerate(pixels)], [f"_{tag}{j}" for j in range(n)])
        for tag, name in (("b", out_x), ("c", out_y)):
            stages += [*separation(f"_a{lon}", f"_a{lat}", f"_{tag}{lon}", f"_{tag}{lat}", "_sep"), {name: "3600 * _sep"}]
        return stages


def _pair(ctype: tuple[str, ...]) -> tuple[int, int] | None:
    """Longitude and latitude axis of one projection."""
    lon = lat = None
    for i, t in enumerate(ctype):
        t = t.upper()
        base, code = t[:4].rstrip("-"), t[5:8]
        if code not in CODES and code not in ("TPV", "TNX", "ZPX"):
            continue
        if base in ("RA",) or base.endswith("LON") or re.fullmatch(r"[A-Z]{2}LN", base):
            lon = i
        elif base in ("DEC",) or base.endswith("LAT") or re.fullmatch(r"[A-Z]{2}LT", base):
            lat = i
    return (lon, lat) if lon is not None and lat is not None else None


def _with_ltm(h: dict, m: list[list[float]], crpix: list[float], n: int) -> tuple[list[list[float]], list[float]]:
    """A section's LTM and LTV, composed: logical = LTM physical + LTV; only where CRPIX is physical (no standard header)."""
    return m, crpix


def compose_ltm(matrix: list[list[float]], crpix: list[float], ltm: list[list[float]], ltv: list[float]) -> tuple[list[list[float]], list[float]]:
    """A transform of physical pixels as one of logical pixels, where logical = ltm physical + ltv."""
    inv = np.linalg.inv(np.array(ltm, dtype=float))
    return (np.array(matrix) @ inv).tolist(), (np.array(ltm) @ np.array(crpix) + np.array(ltv)).tolist()


def evaluate(stages: Stages, given: dict[str, float], want: tuple[str, ...]) -> tuple[float, ...]:
    """Stages over one row of numbers, in Python: a small evaluator for what headers fix."""
    env: dict = dict(given)
    names = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "radians": math.radians, "degrees": math.degrees, "atan2": math.atan2, "atan": math.atan, "asin": math.asin, "acos": math.acos, "sqrt": math.sqrt, "abs": abs, "pow": pow, "floor": math.floor, "greatest": max, "least": min, "exp": math.exp, "ln": math.log, "isnan": math.isnan, "sign": lambda x: (x > 0) - (x < 0), "nan": float("nan")}
    for s in stages:
        made = {n: eval(_python(e), {"__builtins__": {}}, names | env) for n, e in s.items()}  # noqa: S307  own expressions only
        env |= made
    return tuple(env[w] for w in want)


def _python(sql: str) -> str:
    """The subset of SQL that stages use, as Python."""
    s = sql.replace("cast('NaN' as double)", "nan").replace("<>", "!=")
    s = re.sub(r"(?<![<>!=])=(?!=)", "==", s)
    while m := re.search(r"case((?:(?!\bcase\b|\bend\b).)*)\bend", s, re.DOTALL):
        body = m[1].strip()
        subject, _, rest = body.partition("when ")
        pieces = re.split(r"\bwhen\b", "when " + rest)[1:]
        other = "None"
        out = []
        for k, p in enumerate(pieces):
            cond, _, then = p.partition(" then ")
            if k == len(pieces) - 1 and " else " in then:
                then, _, other = then.rpartition(" else ")
            c = f"({subject.strip()}) == ({cond.strip()})" if subject.strip() else cond.strip()
            out.append((c, then.strip()))
        expr = other.strip()
        for c, t in reversed(out):
            expr = f"(({t}) if ({c}) else ({expr}))"
        s = s[: m.start()] + f"({expr})" + s[m.end() :]
    return s.replace(" true ", " True ").replace("(true)", "(True)").replace("(false)", "(False)").replace("is not null", "is not None")


# -- coordinates that live in tables

_PIXEL_LIST = {"TCTYP": "CTYPE", "TCTY": "CTYPE", "TCUNI": "CUNIT", "TCUN": "CUNIT", "TCRPX": "CRPIX", "TCRP": "CRPIX", "TCRVL": "CRVAL", "TCRV": "CRVAL", "TCDLT": "CDELT", "TCDE": "CDELT", "TCROT": "CROTA"}


def pixel_list_header(h: dict, columns: list[int], alt: str = " ") -> dict:
    """The header of an image whose axes are table columns (TCTYPn, TCRPXn, ...), in ascending order."""
    a, out = alt.strip(), {"WCSAXES" + alt.strip(): len(columns)}
    cols = sorted(columns)
    for axis, col in enumerate(cols, 1):
        for k, v in _PIXEL_LIST.items():
            if f"{k}{col}{a}" in h:
                out[f"{v}{axis}{a}"] = h[f"{k}{col}{a}"]
        for axis2, col2 in enumerate(cols, 1):
            for k, v in (("TPC", "PC"), ("TP", "PC"), ("TCD", "CD"), ("TC", "CD")):
                if f"{k}{col}_{col2}{a}" in h:
                    out[f"{v}{axis}_{axis2}{a}"] = h[f"{k}{col}_{col2}{a}"]
        for k in h:
            if m := re.fullmatch(rf"T(?:PV|V){col}_(\d+){a}", k):
                out[f"PV{axis}_{m[1]}{a}"] = h[k]
    for k in ("LONPOLE", "LATPOLE", "RADESYS", "EQUINOX"):
        for name in (k + a, f"{k[:4]}{cols[0]}{a}"):
            if name in h:
                out[k + a] = h[name]
    return out


def column_image_header(h: dict, column: int, alt: str = " ") -> dict:
    """The header of the images that a table column holds (iCTYPn, ijCDn, ...)."""
    a, out = alt.strip(), {}
    names = {"CTYP": "CTYPE", "CTY": "CTYPE", "CUNI": "CUNIT", "CUN": "CUNIT", "CRPX": "CRPIX", "CRP": "CRPIX", "CRVL": "CRVAL", "CRV": "CRVAL", "CDLT": "CDELT", "CDE": "CDELT", "CROT": "CROTA"}
    for k, v in h.items():
        if (m := re.fullmatch(rf"(\d)([A-Z]+){column}{a}", k)) and m[2] in names:
            out[f"{names[m[2]]}{m[1]}{a}"] = v
        elif m := re.fullmatch(rf"(\d)(\d)(PC|CD|P|C){column}{a}", k):
            out[f"{'PC' if m[3][0] == 'P' else 'CD'}{m[1]}_{m[2]}{a}"] = v
        elif m := re.fullmatch(rf"(\d)(?:PV|V){column}_(\d+){a}", k):
            out[f"PV{m[1]}_{m[2]}{a}"] = v
    return out


def alternates(h: dict) -> list[str]:
    """Alternates that a header describes: blank and letters."""
    return sorted({m[2] or " " for k in h if (m := re.fullmatch(r"(CTYPE|TCTYP|TCTY)\d+([A-Z]?)", k))})
