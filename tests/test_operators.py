"""Headers as frames, fits, units, dates, tables and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolane.functions import tabular, timescale, units
from astrolane.functions.distortion import Surface
from astrolane.operators import fit, header
from astrolane.operators.wcs import Wcs, alternates, column_image_header, evaluate, pixel_list_header
from astrolane.sources import api
from astrolane.sources import container as ct
from astrolane.stages import Flow, apply, doubles
from astrolane.streaming import arrivals


def cards_of(spark, lines, extra=()):
    return header.parse(spark.createDataFrame([("f", 0, i, x.ljust(80)) for i, x in enumerate(lines)] + list(extra), "file string, hdu int, pos int, card string"))


def test_cards(spark):
    lines = ["SIMPLE  =                    T / ok", "OBJECT  = 'it''s / M 31  '  / [none] name", "CRVAL1  =            1.5D+02", "HIERARCH ESO DET ID = 7 / id", "HISTORY made", "NUL     =", "LONG    = 'abc&'", "CONTINUE  'def&' / x", "CONTINUE  'ghi'", "MJD_OBS =                  5.5", "BAD     = 12abc", "EXPTIME =  30.0 / [s] time"]
    rows = {r["keyword"]: r for r in header.merge_continue(cards_of(spark, lines), ["file", "hdu"]).collect()}
    assert rows["OBJECT"]["s"] == "it's / M 31" and rows["OBJECT"]["unit"] == "none" and rows["CRVAL1"]["d"] == 150 and rows["ESO DET ID"]["l"] == 7 and rows["LONG"]["s"] == "abcdefghi" and rows["NUL"]["vtype"] == "undefined" and rows["BAD"]["vtype"] == "unparsed" and rows["SIMPLE"]["b"] is True
    got = header.first(cards_of(spark, lines), ["file", "hdu"], "MJD-OBS", "d").first()
    assert got["MJD-OBS"] == 5.5 and header.first(cards_of(spark, lines), ["file", "hdu"], "CR-VAL1", "d").count() == 0
    assert header.pivot(cards_of(spark, lines), ["file", "hdu"], {"CRVAL1": "d", "OBJECT": "s"}).first()["CRVAL1"] == 150
    text = "".join(x.ljust(80) for x in [*lines, "END", "AFTER   = 1"])
    assert header.explode_header(spark.createDataFrame([(1, text)], "id int, h string"), "h").count() == len(lines)


def test_inherit_validate_fix(spark):
    primary = ["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "OBJECT  = 'A'", "FILTER  = 'V'"]
    child = [("f", 1, i, x.ljust(80)) for i, x in enumerate(["XTENSION= 'IMAGE'", "NAXIS   =                    2", "BITPIX  =                  -32", "NAXIS1  =                    3", "INHERIT =                    T", "FILTER  = 'R'", "EPOCH   =               2000.0", "DATE-OBS= '23/07/69'", "EXPTIME = '30'", "BLANK   =                    0"])]
    cards = cards_of(spark, primary, child)
    got = header.inherit(cards.filter("hdu = 1"), cards.filter("hdu = 0"), ["file", "hdu"])
    assert {r["keyword"]: r["s"] for r in got.collect() if r["keyword"] in ("FILTER", "OBJECT", "SIMPLE")} == {"FILTER": "R", "OBJECT": "A"}
    found = {(r["keyword"], r["level"]) for r in header.validate(cards.filter("hdu = 1"), ["file", "hdu"]).collect()}
    assert {("EPOCH", "warning"), ("DATE-OBS", "warning"), ("EXPTIME", "warning"), ("BLANK", "warning"), ("BITPIX", "error"), ("NAXISn", "error")} == found
    fixed = {r["keyword"]: r for r in header.fix(cards.filter("hdu = 1"), ["file", "hdu"]).collect()}
    assert "EPOCH" not in fixed and "EQUINOX" in fixed and fixed["DATE-OBS"]["s"] == "2069-07-23" and fixed["EXPTIME"]["d"] == 30 and "BLANK" not in fixed


def test_observatory():
    a = header.observatory({"OBSGEO-B": 28.76, "OBSGEO-L": -17.88, "OBSGEO-H": 2396.0})
    b = header.observatory({"OBSGEO-X": a["x"], "OBSGEO-Y": a["y"], "OBSGEO-Z": a["z"]})
    assert abs(b["lat"] - 28.76) < 1e-9 and abs(b["h"] - 2396) < 1e-4 and header.observatory({}) is None


def test_fit(spark):
    truth = Wcs.from_header({"CTYPE1": "RA---TAN-SIP", "CTYPE2": "DEC--TAN-SIP", "CRPIX1": 500.0, "CRPIX2": 400.0, "CRVAL1": 150.0, "CRVAL2": 30.0, "CD1_1": -1e-4, "CD1_2": 2e-5, "CD2_1": 1.5e-5, "CD2_2": 1.1e-4, "A_2_0": 1e-6, "B_1_1": -2e-6})
    grid = spark.createDataFrame([(float(i % 20 * 50), float(i // 20 * 45)) for i in range(400)], "x double, y double")
    held = lambda w: spark.createDataFrame(w.pixel_to_world(grid, ["x", "y"], ["ra", "de"]).collect(), "x double, y double, ra double, de double")
    sky = held(truth).repartition(5)
    got = fit.fit_wcs(sky, "x", "y", "ra", "de", crval=(150.0, 30.0), crpix=(500.0, 400.0), sip_order=3)
    assert got.n == 400 and got.rms_arcsec < 1e-5 and abs(got.wcs.sip.a[2, 0] - 1e-6) < 1e-10
    flat = Wcs.from_header({"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRPIX1": 500.0, "CRPIX2": 400.0, "CRVAL1": 150.0, "CRVAL2": 30.0, "CD1_1": -1e-4, "CD1_2": 2e-5, "CD2_1": 1.5e-5, "CD2_2": 1.1e-4})
    free = fit.fit_wcs(held(flat), "x", "y", "ra", "de")
    assert free.rms_arcsec < 1e-4 and free.max_arcsec < 1e-4  # another tangent point bends the plane by so little
    with pytest.raises(ValueError):
        fit.fit_wcs(sky.limit(2), "x", "y", "ra", "de")


def test_units():
    f = lambda a, b: units.parse_unit(a).factor_to(units.parse_unit(b))
    assert f("km/s", "m s-1") == 1000 and f("Jy", "erg s-1 cm-2 Hz-1") == pytest.approx(1e-23) and f("rad", "deg") == pytest.approx(57.29577951308232) and f("sqrt(m2)", "cm") == pytest.approx(100) and f("mm**(3/2)", "m1.5") == pytest.approx(1e-3**1.5)
    assert units.parse_unit("seconds", lenient=True) == units.parse_unit("s")
    k, off = units.parse_unit("mag(Jy)").linear_to(units.parse_unit("mag(mJy)"))
    assert k == 1 and off == pytest.approx(-7.5)
    for bad in ("foo", "m/", "(m", "mag(AB) m", "**2"):
        with pytest.raises(units.UnitError):
            units.parse_unit(bad)
    with pytest.raises(units.UnitError):
        f("m", "s")
    q = units.Quantity.parse("3 km") / units.Quantity.parse("2 s")
    assert q.to("m/s").value == 1500 and (units.Quantity.parse("1 m") + units.Quantity.parse("50 cm")).value == 1.5


def test_dates(spark):
    known = {"2000-01-01T12:00:00": 51544.5, "1858-11-17": 0.0, "2016-12-31T23:59:60": 57754.0, "-4713-11-24T12:00:00": -2400000.5, "2024-02-30": None, "0000-03-01": -678881.0}
    df = spark.createDataFrame([(k,) for k in known], "iso string")
    for r in apply(df, timescale.iso_to_mjd("iso", "mjd")).collect():
        assert r["mjd"] == known[r["iso"]], r
    tt = apply(spark.range(1).selectExpr("57754.0D + 69.184D / 86400 as m"), timescale.mjd_to_utc("m", "TT", "u")).first()["u"]
    assert abs(tt - 57754.0) * 86400 < 1e-4


def test_tables(spark):
    grid = tabular.TabGrid(np.array([[[10 + 0.1 * i + 0.02 * j + 0.004 * i * j, 20 + 0.03 * i + 0.1 * j - 0.002 * i * j] for i in range(5)] for j in range(4)]), (np.arange(1.0, 6.0), np.array([1.0, 2.0, 4.0, 7.0])))
    df = spark.createDataFrame([(1.0, 1.0), (3.5, 2.5), (5.0, 7.0), (1.25, 3.75)], "a double, b double")
    out = grid.transform(grid.transform(df, ["a", "b"], ["ra", "de"]), ["ra", "de"], ["a2", "b2"], inverse=True).collect()
    assert all(abs(r["a"] - r["a2"]) < 1e-6 and abs(r["b"] - r["b2"]) < 1e-6 for r in out) and out[0]["ra"] == pytest.approx(10)
    table = spark.createDataFrame([(0.0, 1.0), (2.0, 5.0), (4.0, 6.0)], "i double, v double")
    got = tabular.interval_join(spark.createDataFrame([(1.0,), (3.0,), (9.0,)], "p double"), "p", table, "i", "v", "w").collect()
    assert sorted((r["p"], r["w"]) for r in got) == [(1.0, 3.0), (3.0, 5.5), (9.0, None)]


def test_surface_bases():
    s = Surface(1, 3, 2, 1, (-2.0, 4.0, 0.0, 10.0), (1.0, 2.0, 3.0, 4.0, 5.0, 6.0))
    x, y = 1.7, 3.3
    u, v = (2 * x - 2) / 6, (2 * y - 10) / 10
    want = (1 + 2 * u + 3 * (2 * u * u - 1)) + v * (4 + 5 * u + 6 * (2 * u * u - 1))
    assert sum(c * x**p * y**q for (p, q), c in s.terms().items()) == pytest.approx(want)


def test_table_coordinates():
    h = {"TCTYP3": "RA---TAN", "TCTYP5": "DEC--TAN", "TCRPX3": 1.0, "TCRVL3": 10.0, "TCDLT3": 0.1, "TCRPX5": 2.0, "TCRVL5": 20.0, "TCDLT5": 0.2}
    w = Wcs.from_header(pixel_list_header(h, [5, 3]))
    assert w.ctype == ("RA---TAN", "DEC--TAN") and w.crval == (10.0, 20.0) and w.matrix == ((0.1, 0.0), (0.0, 0.2)) and alternates(h) == [" "]
    v = Wcs.from_header(column_image_header({"1CTYP4": "RA---SIN", "2CTYP4": "DEC--SIN", "1CRVL4": 5.0, "12PC4": 0.5, "2CDLT4": 3.0}, 4))
    assert v.ctype == ("RA---SIN", "DEC--SIN") and v.crval[0] == 5.0 and v.matrix == ((1.0, 0.5), (0.0, 3.0))


def test_flow_is_one_plan(spark):
    f = Flow("nation").let(a="n_nationkey * 2").let(a="a + 1", b="a").where("a > 5").select(k="n_nationkey", a="a", b="b")
    assert "REPLACE" in f.sql() and doubles("x + 1.5 - '2.5' + t1.5") == "x + 1.5e0 - '2.5' + t1.5"
    r = f.frame(spark, "/root/testdata/sf0.001").orderBy("k").first()
    assert (r["k"], r["a"], r["b"]) == (3, 7, 6)
    assert evaluate([{"a": "case when x > 1 then sqrt(x) else -1 end"}, {"b": "case a when 2 then 5 else 6 end"}], {"x": 4.0}, ("a", "b")) == (2.0, 5)


def test_scans_are_pruned(spark):
    from astrolane.plans import catalog

    plan = catalog.queries()["box_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_extendedprice" in plan


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    a = np.arange(12, dtype=np.float64).reshape(3, 4)
    a[0, 0] = math.nan
    api.write(str(folder / "a.fits"), [ct.image_hdu(a)])
    q = arrivals.pixel_stats(arrivals.pixels(spark, str(folder))).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.sql("select * from stats").first()
    assert (r["n"], r["min"], r["max"], r["mean"]) == (11, 1.0, 11.0, 6.0)
    q = arrivals.headers(arrivals.files(spark, str(folder))).writeStream.format("memory").queryName("cards").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select value from cards where keyword = 'NAXIS1'").first()["value"] == "4"
