"""Times of headers, values in units, sections, lookup tables, positional edits and inverse fits."""

import numpy as np
import pytest

from astrolane.operators import fit, header, section, times
from astrolane.operators.wcs import Wcs
from astrolane.sources import api, fits, tabs
from astrolane.sources import container as ct


def cards(spark, *units):
    rows = [(i, p, f"{k:8}= {v}".ljust(80)) for i, unit in enumerate(units) for p, (k, v) in enumerate(unit.items())]
    return header.parse(spark.createDataFrame(rows, "hdu int, pos int, card string"))


def test_times(spark):
    units = [
        {"MJD-OBS": "57755.0", "TIMESYS": "'TT(TAI)'", "MJD-BEG": "57755.0", "MJD-END": "57755.5", "XPOSURE": "2.0 / [min] open"},
        {"DATE-OBS": "'2017-01-02'", "UTSTART": "'12:00:00'", "UTSTOP": "'2017-01-02T18:00:00'", "EXPTIME": "300.0"},
        {"MJDREF": "57754.0", "TSTART": "100.0", "TSTOP": "400.0", "TIMEOFFS": "50.0", "TIMEPIXR": "0.0"},
        {"JEPOCH": "2000.0", "TELAPSE": "0.5", "TIMEUNIT": "'d'", "MJDREFI": "57754", "MJDREFF": "0.25", "MJDREF": "1.0"},
        {"BEPOCH": "1900.0", "MJDREFI": "57754", "MJDREF": "57000.0", "TELAPSE": "1.0", "TIMEUNIT": "'S'"},
        {"MJD-OBS": "57754.0", "TIMESYS": "'UT1'", "JDREFI": "2457754", "TELAPSE": "1", "TIMEUNIT": "'deg'"},
        {"MJD_OBS": "57754.0", "TIMESYS": "'GPS'", "DATEREF": "'1858-11-18'", "TIMEDEL": "1.0", "TIMEUNIT": "'cy'"},
        {"MJD-OBS": "57755.0", "TIMESYS": "'TCB'", "DATE-AVG": "'2017-01-02T12:00:00'", "TIMSYER": "3", "TIMRDER": "x"},
        {"OBJECT": "'M 31'"},
    ]
    got = {r["hdu"]: r for r in times.times(cards(spark, *units), ["hdu"]).collect()}
    tt = (32.184 + 37) / 86400
    assert got[0]["mjd_obs"] == pytest.approx(57755 - tt, abs=1e-9) and got[0]["mjd_avg"] == pytest.approx(57755.25 - tt, abs=1e-9) and got[0]["exposure"] == 120
    assert (got[1]["mjd_obs"], got[1]["mjd_begin"], got[1]["mjd_end"], got[1]["exposure"]) == (57755.0, 57755.5, 57755.75, 300.0) and got[1]["time_sys"] == "UTC" and got[1]["pixel_ref"] == 0.5
    assert got[2]["mjd_begin"] == pytest.approx(57754 + 150 / 86400, abs=1e-10) and got[2]["mjd_end"] == pytest.approx(57754 + 450 / 86400, abs=1e-10) and (got[2]["mjd_ref"], got[2]["offset"], got[2]["pixel_ref"]) == (57754.0, 50.0, 0.0)
    assert got[3]["mjd_obs"] == pytest.approx(51544.5 - (32.184 + 32) / 86400, abs=1e-9) and got[3]["elapsed"] == 43200 and got[3]["mjd_ref"] == 57754.25
    assert got[4]["mjd_obs"] == pytest.approx(15019.81352 - 32.184 / 86400, abs=1e-9) and got[4]["mjd_ref"] == 57000 and got[4]["elapsed"] == 1
    assert got[5]["mjd_obs"] is None and got[5]["mjd_ref"] is None and got[5]["elapsed"] is None
    assert got[6]["mjd_obs"] == pytest.approx(57754 - 18 / 86400, abs=1e-9) and got[6]["mjd_ref"] == 1 and got[6]["resolution"] == pytest.approx(3155760000)
    tdb = 57755 - 1.550519768e-8 * (57755 - 43144.0003725) - 6.55e-5 / 86400
    assert got[7]["mjd_obs"] == pytest.approx(tdb - tt, abs=1e-7) and got[7]["systematic_error"] == 3 and got[7]["random_error"] is None and got[7]["mjd_avg"] is not None
    assert got[8]["mjd_obs"] is None and got[8]["time_unit"] == "s"
    assert times.times(cards(spark, {"A": "1"}).limit(0), ["hdu"]).count() == 0


@pytest.mark.parametrize("unit, want", [("sec", 1), ("SEC", 1), ("seconds", 1), ("S", 1), ("day", 86400), ("DAY", 86400), ("hr", 3600), ("a", 31557600), ("deg", None), (None, None), ("", None)])
def test_time_units(unit, want):
    assert times.seconds_in(unit) == want
    assert 365.2421 < times.seconds_in("Ba") / 86400 < 365.2423 and times.seconds_in("Ba") < times.seconds_in("a")


def test_values_in_units(spark):
    df = cards(spark, {"FOCUS": "1.5 / [km] length"}, {"FOCUS": "7 / no unit"}, {"FOCUS": "3.0 / [s] time"}, {"FOCUS": "'text'"}, {"FOCUS": "2.0 / [degrees] x"})
    read = lambda out: {r["hdu"]: r["value"] for r in out.collect()}
    assert read(times.real_in_unit(df, ["hdu"], "focus", "m")) == {0: 1500, 1: 7, 2: None, 3: None, 4: None}
    assert read(times.real_in_canonical(df, ["hdu"], "FOCUS")) == {0: 1500, 1: None, 2: 3, 3: None, 4: 2}


def test_sections(spark, tmp_path):
    a = np.arange(120, dtype=np.int32).reshape(4, 5, 6)
    path = str(tmp_path / "c.fits")
    api.write(path, [ct.image_hdu(a)])
    pixels = fits.read(spark, path, "image")
    for key in (np.s_[1], np.s_[1:3, 2], np.s_[-1, 1:, 2:5], np.s_[:, ::2, 1:6:2], np.s_[::-1, 3], ([0, 2], 1), np.s_[2:2]):
        got = sorted(int(r["raw"]) for r in section.section(pixels, key, a.shape).select("raw").collect())
        assert got == sorted(np.ravel(a[key]).tolist()), key
    assert section.region(np.s_[-1, 1:], a.shape) == ([3, 1, 0], [1, 4, 6], [True, False, False]) and section.region(np.s_[::2], a.shape) is None and section.region((1, 2, 3, 4), a.shape) is None
    with pytest.raises(IndexError):
        section.region(4, a.shape)


def test_lookup_tables(spark, tmp_path):
    waves, knots = np.array([5.0, 6.0, 8.0, 12.0]), np.array([1.0, 2.0, 3.0, 4.0])
    grid = np.arange(12, dtype=float).reshape(3, 2, 2)
    raw = waves.astype(">f8").tobytes() + knots.astype(">f8").tobytes() + grid.astype(">f8").tobytes()
    path = str(tmp_path / "t.fits")
    api.write(path, [ct.image_hdu(None), ct.table_hdu(["W", "I", "G"], ["4D", "4D", "12D"], raw, 1, cards={"TDIM1": "(1,4)", "TDIM3": "(2,2,3)", "EXTNAME": "LOOK"})])
    h = {"WCSAXES": 1, "CTYPE1": "WAVE-TAB", "CRPIX1": 1.0, "CRVAL1": 1.0, "CDELT1": 1.0, "PS1_0": "LOOK", "PS1_1": "W", "PS1_2": "I"}
    lines, grids = tabs.resolve_tab(path, h)
    assert lines[0].values == (5.0, 6.0, 8.0, 12.0) and not grids
    w = Wcs.from_header(h, tab=lines)
    out = w.pixel_to_world(spark.createDataFrame([(0.0,), (1.5,), (3.0,)], "p double"), ["p"], ["w"]).orderBy("p").collect()
    assert [r["w"] for r in out] == [5.0, 7.0, 12.0]
    two = {"WCSAXES": 2, "CTYPE1": "WAVE-TAB", "CTYPE2": "STOK-TAB", **{f"PS{i}_0": "LOOK" for i in (1, 2)}, **{f"PS{i}_1": "G" for i in (1, 2)}, "PV1_3": 1, "PV2_3": 2}
    _, grids = tabs.resolve_tab(path, two)
    assert (grids[0, 1].coords == grid).all()
    for wrong in ({**h, "PS1_0": "NONE"}, {**h, "PS1_1": "X"}, {**h, "PV1_2": 2}, {**h, "PS1_1": "G"}):
        with pytest.raises(ct.FormatError):
            tabs.resolve_tab(path, wrong)


def test_positional_edits():
    h = ct.Header([ct.Card("A", 1), ct.Card("B", 2), ct.Card("COMMENT", "x", "", "commentary")])
    assert h.set_before("B", "C", 3) and h.set_after("B", "D", 4, "note") and not h.set_after("NONE", "E", 5)
    h.insert(0, "A", 9)
    h.push_commentary("HISTORY", "made")
    assert [c.keyword for c in h.cards] == ["A", "A", "C", "B", "D", "COMMENT", "E", "HISTORY"] and h.get("A") == 9
    assert h.rename("A", "F") == 2 and h.rename("COMMENT", "G") == 0
    for bad in ("TOOLONGKEY", "a b\n", "Ä", ""):
        with pytest.raises(ct.FormatError):
            h.insert(0, bad, 1)


def test_inverse_fit(spark):
    truth = Wcs.from_header({"CTYPE1": "RA---TAN-SIP", "CTYPE2": "DEC--TAN-SIP", "CRPIX1": 500.0, "CRPIX2": 400.0, "CRVAL1": 150.0, "CRVAL2": 30.0, "CD1_1": -1e-4, "CD1_2": 2e-5, "CD2_1": 1.5e-5, "CD2_2": 1.1e-4, "A_2_0": 1e-6, "B_1_1": -2e-6})
    grid = spark.createDataFrame([(float(i % 20 * 50), float(i // 20 * 45)) for i in range(400)], "x double, y double")
    sky = spark.createDataFrame(truth.pixel_to_world(grid, ["x", "y"], ["ra", "de"]).collect(), "x double, y double, ra double, de double")
    pinned = {"crval": (150.0, 30.0), "crpix": (500.0, 400.0), "sip_order": 4}
    sip = fit.fit_wcs(sky, "x", "y", "ra", "de", **pinned).wcs.sip
    at = lambda t, u, v: sum(c * u**p * v**q for (p, q), c in t.items())
    for u, v in ((-400.0, 300.0), (250.0, -200.0), (10.0, 5.0)):
        x, y = u + at(sip.a, u, v), v + at(sip.b, u, v)
        assert x + at(sip.ap, x, y) == pytest.approx(u, abs=1e-3) and y + at(sip.bp, x, y) == pytest.approx(v, abs=1e-3)
    assert not fit.fit_wcs(sky, "x", "y", "ra", "de", **pinned, sip_inverse=False).wcs.sip.ap
