"""Dates and times of headers: one row a unit from a frame of parsed cards, reduced to UTC.

The cards' first values become columns in one aggregate; all that follows is
chains of coalesce over them.  Only factors of units that a card or TIMEUNIT
spells out are looked up in Python, a batch of units at a time.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from astrolane.functions import timescale as ts
from astrolane.functions.units import UnitError, parse_unit
from astrolane.stages import Stages, apply, num

#: Value column of each keyword that is read.
WANTED = {
    **dict.fromkeys(("TIMESYS", "TIMEUNIT", "DATE-OBS", "DATE-BEG", "DATE-END", "DATE-AVG", "DATEREF", "UTSTART", "UTSTOP"), "s"),
    **dict.fromkeys(("MJDREFI", "JDREFI"), "l"),
    **dict.fromkeys(("MJD-OBS", "MJD-BEG", "MJD-END", "MJD-AVG", "JEPOCH", "BEPOCH", "MJDREFF", "MJDREF", "JDREFF", "JDREF", "EXPTIME", "TIMEPIXR"), "d"),
    **dict.fromkeys(("TSTART", "TSTOP", "TIMEOFFS", "XPOSURE", "TELAPSE", "TIMEDEL", "TIMSYER", "TIMRDER"), "d"),
}
#: Keywords in TIMEUNIT, or in the unit that their comment gives.
DURATIONS = ("TSTART", "TSTOP", "TIMEOFFS", "XPOSURE", "TELAPSE", "TIMEDEL", "TIMSYER", "TIMRDER")
#: Spellings of units of time beside those of lenient parsing.
_SPELT = {"S": "s", "hr": "h", "hrs": "h"}


@lru_cache(maxsize=4096)
def seconds_in(unit: str | None) -> float | None:
    """Seconds in a unit of time, however it is spelt; None where it is none."""
    for text in (unit, (unit or "").lower()):
        try:
            return parse_unit(_SPELT.get(text, text), lenient=True).factor_to(parse_unit("s"))
        except (UnitError, AttributeError, TypeError):
            continue
    return None


@F.pandas_udf(T.DoubleType())
def _seconds_in(unit: pd.Series) -> pd.Series:
    return unit.map(seconds_in).astype(float)


def first_values(cards: DataFrame, keys: list[str], wanted: dict[str, str]) -> DataFrame:
    """First values of keywords as columns; a keyword with a dash is also found with an underscore. With u_KEYWORD, the unit in its comment."""
    out = []
    for k, column in wanted.items():
        names = [k, k.replace("-", "_")]
        at = F.when(F.col("keyword").isin(*names) & (F.col("vtype") != "commentary"), F.struct((F.col("keyword") != k).alias("o"), F.col("pos")))
        out += [F.min_by(column, at).alias(k.replace("-", "_")), F.min_by("unit", at).alias("u_" + k.replace("-", "_"))]
    return cards.groupBy(*keys).agg(*out)


def to_utc(mjd: str, scale: str, out: str) -> Stages:
    """As timescale.mjd_to_utc, with the scale in a column; null for scales without a closed form."""
    base = f"upper(trim(split_part({scale}, '(', 1)))"
    return [
        {"_m": mjd, "_b": base},
        {"_tdb": f"case when _b = 'TCB' then _m - {num(ts.L_B)} * (_m - {num(ts.MJD_0)}) + {num(ts.TDB_0_DAYS)} when _b = 'TDB' then _m end"},
        {"_tt": f"case when _b in ('TT', 'TDT', 'ET') then _m when _b = 'TCG' then _m - {num(ts.L_G)} * (_m - {num(ts.MJD_0)}) else _tdb - {ts.tdb_minus_tt('_tdb')} end"},
        {"_tai": "case when _b in ('TAI', 'IAT') then _m when _b = 'GPS' then _m + 19 / 86400.0 else _tt - 32.184 / 86400.0 end"},
        {out: f"case when _b in ('UTC', 'GMT') then _m else _tai - ({ts.tai_minus_utc('_tai')}) / 86400.0 end"},
    ]


def times(cards: DataFrame, keys: list[str]) -> DataFrame:
    """One row a unit that has cards: keys, time_sys, time_unit, mjd_ref, mjd_obs, mjd_begin, mjd_end, mjd_avg, exposure, elapsed, offset, resolution, pixel_ref, systematic_error and random_error.

    cards: as ``header.parse`` gives them.  Dates are UTC as MJD, durations seconds;
    what a header doesn't say, or says in no unit of time, is null.
    """
    df = first_values(cards, keys, WANTED)
    df = df.withColumns({"time_sys": F.upper(F.trim(F.coalesce("TIMESYS", F.lit("UTC")))), "time_unit": F.trim(F.coalesce("TIMEUNIT", F.lit("s")))})
    df = df.withColumns({"_" + k.lower(): F.col(k) * _seconds_in(F.coalesce("u_" + k, "time_unit")) for k in DURATIONS})
    stages: Stages = []
    for k in ("DATE_OBS", "DATE_BEG", "DATE_END", "DATE_AVG", "DATEREF", "UTSTART", "UTSTOP"):
        stages += ts.iso_to_mjd(k, f"_at_{k.lower()}")
    stages += ts.iso_to_mjd("split_part(DATE_OBS, 'T', 1)", "_night")
    stages += [
        {"mjd_ref": "coalesce(MJDREFI + MJDREFF, MJDREF, coalesce(cast(MJDREFI as double), MJDREFF), JDREFI + JDREFF - 2400000.5, JDREF - 2400000.5, _at_dateref)"},
        {"_zero": "mjd_ref + coalesce(_timeoffs, 0e0) / 86400.0"},
        {"_obs": f"coalesce(MJD_OBS, _at_date_obs, {ts.jepoch_to_mjd('JEPOCH')}, {ts.bepoch_to_mjd('BEPOCH')})", "_obs_scale": "case when coalesce(MJD_OBS, _at_date_obs) is not null then time_sys when JEPOCH is not null then 'TDB' else 'ET' end"},
        *to_utc("_obs", "_obs_scale", "mjd_obs"),
    ]
    for name, mjd, date, rel, ut in (("mjd_begin", "MJD_BEG", "date_beg", "tstart", "utstart"), ("mjd_end", "MJD_END", "date_end", "tstop", "utstop")):
        stages += [*to_utc(f"coalesce({mjd}, _at_{date}, _zero + _{rel} / 86400.0)", "time_sys", name), {name: f"coalesce({name}, _at_{ut}, _night + {ts.parse_hms(ut.upper())} / 86400.0)"}]
    stages += [*to_utc("coalesce(MJD_AVG, _at_date_avg)", "time_sys", "mjd_avg"), {"mjd_avg": "case when coalesce(MJD_AVG, _at_date_avg) is not null then mjd_avg else (mjd_begin + mjd_end) / 2 end"}]
    stages += [{"exposure": "coalesce(_xposure, EXPTIME)", "elapsed": "_telapse", "offset": "_timeoffs", "resolution": "_timedel", "pixel_ref": "coalesce(TIMEPIXR, 0.5)", "systematic_error": "_timsyer", "random_error": "_timrder"}]
    return apply(df, stages, drop=False).select(*keys, "time_sys", "time_unit", "mjd_ref", "mjd_obs", "mjd_begin", "mjd_end", "mjd_avg", "exposure", "elapsed", "offset", "resolution", "pixel_ref", "systematic_error", "random_error")


@lru_cache(maxsize=4096)
def _linear(source: str | None, target: str | None) -> tuple[float, float] | None:
    """Factor and offset between units; target None: the base units of the dimension."""
    try:
        a = parse_unit(source, lenient=True)
        return a.linear_to(parse_unit(target, lenient=True) if target is not None else type(a)(1.0, a.dims))
    except (UnitError, TypeError, AttributeError):
        return None


def _converted(value: Column, source: Column, target: str | None) -> Column:
    @F.pandas_udf("factor double, shift double")
    def line(unit: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_linear(u, target) or (None, None) for u in unit], columns=["factor", "shift"], dtype=float)

    k = line(source)
    return value * k["factor"] + k["shift"]


def real_in_unit(cards: DataFrame, keys: list[str], keyword: str, unit: str) -> DataFrame:
    """The first value of a keyword in a unit. Without a unit in its comment it is in that already; null where it is no number or the units don't convert."""
    name = keyword.upper().replace("-", "_")
    df = first_values(cards, keys, {keyword.upper(): "d"})
    return df.select(*keys, _converted(F.col(name), F.coalesce("u_" + name, F.lit(unit)), unit).alias("value"))


def real_in_canonical(cards: DataFrame, keys: list[str], keyword: str) -> DataFrame:
    """The first value of a keyword in the base units of its dimension; null without a unit in its comment."""
    name = keyword.upper().replace("-", "_")
    df = first_values(cards, keys, {keyword.upper(): "d"})
    return df.select(*keys, _converted(F.col(name), F.col("u_" + name), None).alias("value"))
