"""Dates to Modified Julian Dates, leap seconds and time scales, as SQL expressions."""

from __future__ import annotations

from astrolane.stages import PI, Stages, num

#: MJD at which TAI - UTC takes the value, in seconds.
LEAP = ((41317, 10), (41499, 11), (41683, 12), (42048, 13), (42413, 14), (42778, 15), (43144, 16), (43509, 17), (43874, 18), (44239, 19), (44786, 20), (45151, 21), (45516, 22), (46247, 23), (47161, 24), (47892, 25), (48257, 26), (48804, 27), (49169, 28), (49534, 29), (50083, 30), (50630, 31), (51179, 32), (53736, 33), (54832, 34), (56109, 35), (57204, 36), (57754, 37))
L_G, L_B = 6.969290134e-10, 1.550519768e-8
MJD_0 = 43144.0003725
TDB_0_DAYS = -6.55e-5 / 86400


def parse_iso(text: str) -> Stages:
    """_y, _mo, _d, _h, _mi, _s of [+-]Y-M-D[Thh:mm:ss[.f][Z]]; null where it is no calendar date. Second 60 is a leap second."""
    rx = r"^([+-]?[0-9]{4,})-([0-9]{2})-([0-9]{2})(T([0-9]{2}):([0-9]{2})(:([0-9]{2}(\.[0-9]*)?))?Z?)?$"
    part = lambda k, kind: f"cast(nullif(regexp_extract({text}, '{rx}', {k}), '') as {kind})"
    return [
        {"_y": part(1, "bigint"), "_mo": part(2, "bigint"), "_d": part(3, "bigint"), "_h": f"coalesce({part(5, 'bigint')}, 0)", "_mi": f"coalesce({part(6, 'bigint')}, 0)", "_s": f"coalesce({part(8, 'double')}, 0e0)"},
        {"_leap": "_y % 4 = 0 and (_y % 100 <> 0 or _y % 400 = 0)"},
        {"_len": "case when _mo in (4, 6, 9, 11) then 30 when _mo = 2 then case when _leap then 29 else 28 end when _mo between 1 and 12 then 31 else 0 end"},
        {"_valid": "_y is not null and _d between 1 and _len and _h between 0 and 23 and _mi between 0 and 59 and _s < 61"},
    ]


def mjd_of_parts(y: str, mo: str, d: str, out: str) -> Stages:
    """MJD of a proleptic Gregorian date at midnight, any year: floor arithmetic over March-based years."""
    return [
        {"_yy": f"({y}) - case when ({mo}) <= 2 then 1 else 0 end", "_mm": f"({mo}) + case when ({mo}) <= 2 then 9 else -3 end"},
        {"_cen": "floor(_yy / 100.0)"},
        {"_yc": "_yy - 100 * _cen"},
        {out: f"cast(floor(146097 * _cen / 4.0) + floor(1461 * _yc / 4.0) + floor((153 * _mm + 2) / 5.0) + ({d}) - 678882 as double)"},
    ]


def iso_to_mjd(text: str, out: str) -> Stages:
    return [*parse_iso(text), *mjd_of_parts("_y", "_mo", "_d", "_day"), {out: "case when _valid then _day + (_h + (_mi + _s / 60.0) / 60.0) / 24.0 end"}]


def parse_hms(text: str) -> str:
    """Seconds of hh:mm:ss[.f]; null where it is none."""
    rx = r"^\s*([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}(\.[0-9]*)?)\s*$"
    p = lambda k: f"cast(nullif(regexp_extract({text}, '{rx}', {k}), '') as double)"
    return f"({p(1)} * 3600 + {p(2)} * 60 + {p(3)})"


def tai_minus_utc(mjd: str) -> str:
    """Step lookup; 0 before 1972."""
    return "case " + " ".join(f"when ({mjd}) >= {m} then {s}" for m, s in reversed(LEAP)) + " else 0 end"


def tdb_minus_tt(mjd: str) -> str:
    """In days."""
    g = f"radians(357.53 + 0.9856003 * (({mjd}) - 51544.5))"
    return f"((0.001658 * sin({g}) + 0.000014 * sin(2 * {g})) / 86400)"


def mjd_to_utc(mjd: str, scale: str, out: str) -> Stages:
    """An MJD of a time scale as UTC; null for scales without a closed form. Leap seconds are looked up at the TAI date."""
    scale = scale.split("(")[0].strip().upper()
    tai = lambda e: [{"_tai": e}, {out: f"_tai - ({tai_minus_utc('_tai')}) / 86400.0"}]
    from_tt = lambda e: tai(f"({e}) - 32.184 / 86400")
    if scale in ("UTC", "GMT"):
        return [{out: f"({mjd})"}]
    if scale in ("TAI", "IAT"):
        return tai(mjd)
    if scale in ("TT", "TDT", "ET"):
        return from_tt(mjd)
    if scale == "TDB":
        return from_tt(f"({mjd}) - {tdb_minus_tt(mjd)}")
    if scale == "GPS":
        return tai(f"({mjd}) + 19 / 86400.0")
    if scale == "TCG":
        return from_tt(f"({mjd}) - {num(L_G)} * (({mjd}) - {num(MJD_0)})")
    if scale == "TCB":
        return [{"_tdb": f"({mjd}) - {num(L_B)} * (({mjd}) - {num(MJD_0)}) + {num(TDB_0_DAYS)}"}, *from_tt(f"_tdb - {tdb_minus_tt('_tdb')}")]
    return [{out: "cast(null as double)"}]


def jepoch_to_mjd(epoch: str) -> str:
    return f"(51544.5 + (({epoch}) - 2000) * 365.25)"


def bepoch_to_mjd(epoch: str) -> str:
    return f"(15019.81352 + (({epoch}) - 1900) * 365.242198781)"


__all__ = ["LEAP", "PI", "bepoch_to_mjd", "iso_to_mjd", "jepoch_to_mjd", "mjd_of_parts", "mjd_to_utc", "parse_hms", "parse_iso", "tai_minus_utc", "tdb_minus_tt"]
