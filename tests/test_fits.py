"""Files: own fixtures from the byte layouts, the data source, the writer, codecs and edits."""

import gzip
import math

import numpy as np
import pytest

from astrolane.operators import checksum as ck
from astrolane.operators import diff
from astrolane.sources import api, codecs, fits
from astrolane.sources import container as ct


def lcg(n):
    x, out = 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(x)
    return np.array(out)


@pytest.fixture()
def image(tmp_path):
    path = str(tmp_path / "a.fits")
    api.write(path, [ct.image_hdu(np.arange(48, dtype=np.int16).reshape(6, 8), {"OBJECT": "M 31", "BSCALE": 2.0, "BZERO": 100.0, "BLANK": 5})])
    return path


def test_image_modes(spark, image):
    rows = {(r["x"], r["y"]): (r["raw"], r["value"]) for r in fits.read(spark, image, "image").collect()}
    assert len(rows) == 48 and rows[3, 2] == (19.0, 138.0) and math.isnan(rows[5, 0][1])
    some = fits.read(spark, image, "image").filter("x >= 2 and x < 5 and y > 3").collect()
    assert {(r["x"], r["y"]) for r in some} == {(x, y) for x in (2, 3, 4) for y in (4, 5)}
    strips = fits.read(spark, image, "strips", rowsPerPartition=8).orderBy("y").collect()
    assert len(strips) == 6 and strips[1]["value"] == [100 + 2.0 * i for i in range(8, 16)]
    hdus = fits.read(spark, image, "hdus").collect()
    assert [(h["kind"], h["axes"], h["data_start"]) for h in hdus] == [("image", [8, 6], 2880)]
    assert fits.read(spark, image, "cards").filter("keyword = 'OBJECT'").first()["s"] == "M 31"


@pytest.mark.parametrize("kind", [np.uint8, np.int8, np.int16, np.uint16, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64])
def test_types_round_trip(tmp_path, kind):
    a = (np.arange(24).reshape(2, 3, 4) * 3).astype(kind)
    path = str(tmp_path / "t.fits")
    api.write(path, [ct.image_hdu(a)])
    b = api.getdata(path)
    assert b.dtype == a.dtype and (a == b).all()
    with open(path, "rb") as f:
        raw = f.read()
    (tmp_path / "t.fits.gz").write_bytes(gzip.compress(raw))
    assert (api.getdata(str(tmp_path / "t.fits.gz")) == a).all()


def binary_table():
    names = ["FLAG", "BYTE", "INT16", "INT32", "INT64", "FLOAT", "DOUBLE", "NAME", "BITS"]
    forms = ["1L", "1B", "1I", "1J", "1K", "1E", "1D", "8A", "4X"]
    rows = b""
    for r in range(4):
        rows += (b"T" if r % 2 == 0 else b"F") + np.array(r * 20, ">u1").tobytes() + np.array(r * 100 - 150, ">i2").tobytes() + np.array(r * 10000, ">i4").tobytes() + np.array(r * 1000000, ">i8").tobytes() + np.array(r * 1.5, ">f4").tobytes() + np.array(r * 3.14, ">f8").tobytes() + ["NGC1234", "M 31", "IC 342", "NGC 253"][r].encode().ljust(8) + bytes([0b10100000 >> r])
    return ct.table_hdu(names, forms, rows, 4, cards={"EXTNAME": "DATA"})


def vla_table():
    rows = b"".join(np.array(x, ">i4").tobytes() for x in ((2, 0), (3, 8), (1, 20)))
    return ct.table_hdu(["ARRAY"], ["1PJ(3)"], rows, 3, np.array([10, 20, 30, 40, 50, 60], ">i4").tobytes(), {"EXTNAME": "VLA"})


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t.fits")
    text = ct.ascii_hdu(["NAME", "ID", "MAG", "FLUX"], ["A8", "I5", "F8.3", "E12.4"], [("NGC1234", 1234, 8.5, 1.234e-12), ("M31", 321, 12.1, None), ("Orion", 9999, 5.0, 9.999e-10)], {"EXTNAME": "CAT"}, {"FLUX": "-"})
    scaled = ct.table_hdu(["RATE", "COUNT", "U"], ["1I", "1J", "1I"], b"".join(np.array(a, ">i2").tobytes() + np.array(b, ">i4").tobytes() + np.array(c, ">i2").tobytes() for a, b, c in ((0, 100, -32768), (10000, -9999, 0), (-32768, 200, 32767))), 3, cards={"TSCAL1": 0.01, "TZERO1": 32768.0, "TNULL2": -9999, "TZERO3": 32768, "EXTNAME": "SCALED"})
    grid = ct.table_hdu(["M", "S"], ["6J", "6A"], np.arange(6, dtype=">i4").tobytes() + b"abcdef", 1, cards={"TDIM1": "(3,2)", "TDIM2": "(2,3)", "EXTNAME": "GRID"})
    api.write(path, [ct.image_hdu(None), binary_table(), vla_table(), text, scaled, grid])
    rows = fits.read(spark, path, "table", extname="DATA").collect()
    assert rows[1]["FLAG"] is False and rows[2]["INT16"] == 50 and rows[3]["NAME"] == "NGC 253" and rows[1]["BITS"] == [False, True, False, True] and abs(rows[3]["DOUBLE"] - 9.42) < 1e-12
    assert [r["ARRAY"] for r in fits.read(spark, path, "table", extname="VLA").collect()] == [[10, 20], [30, 40, 50], [60]]
    cat = fits.read(spark, path, "table", extname="CAT").collect()
    assert [tuple(r) for r in cat] == [("NGC1234", 1234, 8.5, 1.234e-12), ("M31", 321, 12.1, None), ("Orion", 9999, 5.0, 9.999e-10)]
    got = fits.read(spark, path, "table", extname="SCALED").collect()
    assert [r["RATE"] for r in got] == [32768.0, 32868.0, 32768 - 327.68] and [r["COUNT"] for r in got] == [100, None, 200] and [r["U"] for r in got] == [0, 32768, 65535]
    g = fits.read(spark, path, "table", extname="GRID").first()
    assert g["M"] == [[0, 1, 2], [3, 4, 5]] and g["S"] == ["ab", "cd", "ef"]
    assert [x[3] for x in api.info(path)] == ["image", "bintable", "bintable", "ascii", "bintable", "bintable"]


def test_text_reals():
    for t, d, want in (("", 2, 0.0), ("123", 2, 1.23), ("1.5", 2, 1.5), ("1.5D2", 0, 150.0), ("15+2", 1, 150.0), ("-2.5-1", 0, -0.25)):
        assert ct.text_real(t, d) == pytest.approx(want)


def test_groups(spark, tmp_path):
    h = ct.Header([ct.Card(k, v) for k, v in (("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", 0), ("NAXIS2", 4), ("GROUPS", True), ("PCOUNT", 2), ("GCOUNT", 2), ("PTYPE1", "DATE"), ("PTYPE2", "DATE"), ("PSCAL2", 0.5), ("PZERO1", 10.0))])
    path = str(tmp_path / "g.fits")
    api.write(path, [(h, np.array([1, 2, 10, 11, 12, 13, 2, 4, 20, 21, 22, 23], ">f4").tobytes())])
    rows = fits.read(spark, path, "groups").orderBy("g").collect()
    assert [(r["params"], r["data"]) for r in rows] == [([11.0, 1.0], [10.0, 11.0, 12.0, 13.0]), ([12.0, 2.0], [20.0, 21.0, 22.0, 23.0])]
    assert ct.group_parameter(h, rows[0]["params"], "DATE") == 12.0 and ct.group_parameter(h, rows[0]["params"], "X") is None


def test_headers():
    long_text = "it's a long text, " * 12
    h = ct.Header([ct.Card("SIMPLE", True), ct.Card("LONG", long_text), ct.Card("ESO DET ID", 7, "id"), ct.Card("NUL"), ct.Card("X", 1e-7), ct.Card("C", 1 + 2j), ct.Card("HISTORY", "made", "", "commentary"), ct.Card("MJD_OBS", 5.5), ct.Card("CD1-1", 3)])
    raw = h.to_bytes()
    g = ct.Header.parse(raw)
    assert len(raw) % 2880 == 0 and g.get("LONG") == long_text.rstrip() and g.get("ESO DET ID") == 7 and g.get("NUL") is None and g.get("X") == 1e-7 and g.get("C") == 1 + 2j and g.history() == ["made"]
    assert g.get("MJD-OBS") == 5.5 and g.get("CD1_1") is None
    assert ct.parse_value("'a / b''c' / note") == ("a / b'c", "note") and ct.parse_value(" 1.5D+02 /x")[0] == 150.0
    child = ct.Header([ct.Card("INHERIT", True), ct.Card("A", 1)])
    assert set(child.inherit(ct.Header([ct.Card("SIMPLE", True), ct.Card("A", 2), ct.Card("B", 3)])).values()) == {"INHERIT", "A", "B"}
    bad = "BAD     = 12abc".ljust(80).encode()
    assert ct.Header.parse(bad).cards[0].kind == "unparsed"
    with pytest.raises(ct.FormatError):
        ct.Header.parse(bad, lenient=False)


def test_checksums(tmp_path):
    path = str(tmp_path / "c.fits")
    api.write(path, [ct.image_hdu(np.arange(16, dtype=np.float32).reshape(4, 4)), binary_table()], checksums=True)
    assert api.verify_checksums(path) == [{"hdu": i, "checksum_ok": True, "datasum_ok": True} for i in range(2)]
    raw = bytearray(open(path, "rb").read())
    raw[2880 + 5] ^= 1
    open(path, "wb").write(raw)
    assert api.verify_checksums(path)[0] == {"hdu": 0, "checksum_ok": False, "datasum_ok": False}
    for v in (0, 1, 0x3A3A3A3A, 0xFFFFFFFF, 868229149, 2503531142):
        assert ck.decode(ck.encode(v)) == v and ck.encode(v).isalnum()
    assert ck.encode(868229149) == "hcHjjc9ghcEghc9g"


def test_compressed(spark, tmp_path):
    a = (lcg(33 * 17) % 1000 - 500).astype(np.int16).reshape(17, 33)
    path, out = str(tmp_path / "z.fits"), str(tmp_path / "u.fits")
    api.write(path, [ct.image_hdu(None), ct.compressed_hdu(a, [16, 4], {"EXTNAME": "IMG"})])
    assert (api.getdata(path, 1) == a).all()
    assert len(fits.read(spark, path, "tiles").collect()) == 15
    assert sum(r["raw"] for r in fits.read(spark, path, "image").collect()) == a.sum()
    api.funpack(path, out)
    assert (api.getdata(out, 1) == a).all() and all(x["checksum_ok"] for x in api.verify_checksums(out))


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n - 1, -1, -1)]

    def done(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), dtype=np.uint8)).tobytes()


def rice_encode(a, size, block):
    sel, top, raw = codecs.RICE[size]
    w, last = BitWriter(), int(a[0])
    w.put(last & (1 << 8 * size) - 1, 8 * size)
    for at in range(0, len(a), block):
        diffs = []
        for v in a[at : at + block]:
            d, last = int(v) - last, int(v)
            d = (d + (1 << 8 * size - 1)) % (1 << 8 * size) - (1 << 8 * size - 1)
            diffs.append(2 * d if d >= 0 else -2 * d - 1)
        mean = sum(diffs) // len(diffs)
        fs = max(0, mean.bit_length() - 1)
        if not any(diffs):
            w.put(0, sel)
        elif fs >= top:
            w.put(top + 1, sel)
            for d in diffs:
                w.put(d, raw)
        else:
            w.put(fs + 1, sel)
            for d in diffs:
                w.put(1, (d >> fs) + 1)
                w.put(d & (1 << fs) - 1, fs)
    return w.done()


@pytest.mark.parametrize("size", [1, 2, 4])
def test_rice(size):
    x = lcg(200)
    a = {1: x % 256, 2: x % 1000 - 500, 4: x - 2**30}[size]
    for b in (a, np.full(70, a[0]), np.concatenate([a[:5], np.full(64, a[5]), a[:9]])):
        assert (codecs.rice_decode(rice_encode(b, size, 32), len(b), size, 32) == b).all()


def test_plio():
    words = [0, 7, -100, 0, 0, 0, 0]
    body = [1 << 12 | 5, 0, 4 << 12 | 3, 0 << 12 | 2, 2 << 12 | 2, 5 << 12 | 4, 6 << 12 | 1, 7 << 12 | 3]
    words[3] = 7 + len(body)
    data = np.array(words + body).astype(">i2").tobytes()
    assert codecs.plio_decode(data, 12).tolist() == [5, 5, 5, 0, 0, 0, 0, 0, 7, 8, 5, 0]


def h_forward(a):
    """Forward H-transform, lossless, for the test's own streams."""
    a = a.astype(np.int64).copy()
    rows, cols = a.shape
    depth, r, c, shift, unit = int(np.ceil(np.log2(max(a.shape)))), rows, cols, 0, 1
    rnd = lambda v, u: (v + np.where(v >= 0, u, u - 1)) & -(u << 1)
    plus = lambda v, u: np.where(v >= 0, v + u, v) & -(u << 1)
    for _ in range(depth):
        p, er, ec = a[:r, :c].copy(), r - r % 2, c - c % 2
        s00, s10, s01, s11 = (p[i:er:2, j:ec:2].copy() for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)))
        p[1:er:2, 1:ec:2] = (s11 - s10 - s01 + s00) >> shift
        p[1:er:2, 0:ec:2] = plus((s11 + s10 - s01 - s00) >> shift, unit)
        p[0:er:2, 1:ec:2] = plus((s11 - s10 + s01 - s00) >> shift, unit)
        p[0:er:2, 0:ec:2] = rnd((s11 + s10 + s01 + s00) >> shift, unit << 1)
        if c % 2:
            t, b = p[0:er:2, c - 1].copy(), p[1:er:2, c - 1].copy()
            p[1:er:2, c - 1], p[0:er:2, c - 1] = plus((b - t) << (1 - shift), unit), rnd((b + t) << (1 - shift), unit << 1)
        if r % 2:
            t, b = p[r - 1, 0:ec:2].copy(), p[r - 1, 1:ec:2].copy()
            p[r - 1, 1:ec:2], p[r - 1, 0:ec:2] = plus((b - t) << (1 - shift), unit), rnd((b + t) << (1 - shift), unit << 1)
            if c % 2:
                p[r - 1, c - 1] = rnd(p[r - 1, c - 1] << (2 - shift), unit << 1)
        sort = lambda n: np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2)])
        a[:r, :c] = p[sort(r)][:, sort(c)]
        r, c, shift, unit = (r + 1) // 2, (c + 1) // 2, 1, unit << 1
    return a


def h_encode(a):
    t = h_forward(a)
    rows, cols = t.shape
    r2, c2 = (rows + 1) // 2, (cols + 1) // 2
    total, t[0, 0] = int(t[0, 0]), 0
    quads = [t[:r2, :c2], t[:r2, c2:], t[r2:, :c2], t[r2:, c2:]]
    planes = [int(abs(q).max()).bit_length() if q.size else 0 for q in quads]
    planes = [planes[0], max(planes[1:3]), planes[3]]
    w = BitWriter()
    for q, n in zip(quads, [planes[0], planes[1], planes[1], planes[2]], strict=True):
        if not q.size:
            continue
        pad = np.zeros(((q.shape[0] + 1) // 2 * 2, (q.shape[1] + 1) // 2 * 2), dtype=np.int64)
        pad[: q.shape[0], : q.shape[1]] = abs(q)
        for bit in range(n - 1, -1, -1):
            b = pad >> bit & 1
            w.put(0, 4)
            for v in (b[0::2, 0::2] << 3 | b[0::2, 1::2] << 2 | b[1::2, 0::2] << 1 | b[1::2, 1::2]).ravel():
                w.put(int(v), 4)
    w.put(0, 4)
    w.bits += [0] * (-len(w.bits) % 8)
    for v in t.ravel():
        if v:
            w.put(int(v < 0), 1)
    return b"\xdd\x99" + b"".join(int(x).to_bytes(4, "big", signed=True) for x in (rows, cols, 0)) + total.to_bytes(8, "big", signed=True) + bytes(planes) + w.done()


@pytest.mark.parametrize("shape", [(8, 8), (16, 16), (5, 7), (12, 40)])
def test_hcompress(shape):
    a = (lcg(shape[0] * shape[1]) % 2000 - 700).reshape(shape)
    got, scale = codecs.hcompress_decode(h_encode(a))
    assert scale == 0 and (got == a).all()


def test_dither():
    t = codecs.dither_table()
    assert int(round(t[-1] * 2147483647)) == 1043618065  # the generator's known last seed
    q = np.array([0, 1, 2, codecs.ZERO_CODE, -5])
    r = codecs.unquantize(q, 0.5, 10.0, "SUBTRACTIVE_DITHER_2", 1, -5)
    at = int(t[0] * 500)
    assert r[1] == pytest.approx((1 - t[at + 1] + 0.5) * 0.5 + 10) and r[3] == 0 and math.isnan(r[4])


def test_writer(spark, tmp_path):
    path = str(tmp_path / "w.fits")
    df = spark.createDataFrame([(1, 2.5, "abc", True), (2, None, "x", None), (None, -1.0, "longer text", False)], "k int, v double, s string, b boolean").repartition(2)
    fits.write_table(df, path, extname="OUT")
    got = {r["s"]: (r["k"], r["v"], r["b"]) for r in fits.read(spark, path, "table").collect()}
    assert got["abc"] == (1, 2.5, True) and got["x"][0] == 2 and math.isnan(got["x"][1]) and got["x"][2] is None and got["longer text"] == (None, -1.0, False)
    assert len(list(tmp_path.iterdir())) == 1
    with pytest.raises(FileExistsError):
        fits.write_table(df, path)
    fits.write_table(df.limit(1), path, overwrite=True)
    assert fits.read(spark, path, "table").count() == 1


def test_edits(tmp_path):
    path = str(tmp_path / "e.fits")
    api.write(path, [ct.image_hdu(np.zeros((4, 4), dtype=np.int32))])
    api.setval(path, "OBJECT", "M1", comment="target")
    assert api.getval(path, "OBJECT") == "M1"
    api.delval(path, "OBJECT")
    api.append(path, binary_table())
    assert len(api.info(path)) == 2
    with api.open_file(path, "update") as f:
        f.patch(0, (1, 2), np.array([[7, 8]], dtype=np.int32))
        f.insert(1, vla_table())
        del f[2]
    a = api.getdata(path, 0)
    assert a[2, 1] == 7 and a[2, 2] == 8 and a.sum() == 15 and api.info(path)[1][1] == "VLA"
    with pytest.raises(ct.FormatError):
        api.open_file(path).append(binary_table())
    assert api.stats(path)[0]["n"] == 16 and api.stats(path)[0]["max"] == 8


def test_diff(spark, tmp_path):
    a, b = str(tmp_path / "a.fits"), str(tmp_path / "b.fits")
    x = np.arange(16, dtype=np.float32).reshape(4, 4)
    y = x.copy()
    y[1, 1] += 0.25
    api.write(a, [ct.image_hdu(x, {"OBJECT": "A", "ONLY": 1}), binary_table()])
    api.write(b, [ct.image_hdu(y, {"OBJECT": "B"}), binary_table()])
    d = diff.files(a, b)
    assert not d.identical and d.hdus[0].total == 1 and [h[0] for h in d.hdus[0].header] == ["OBJECT", "ONLY"] and d.hdus[1].empty
    assert diff.files(a, b, atol=0.3, ignore=["object", "only"]).identical and diff.files(a, a).report() == "identical"
    cards = [fits.read(spark, p, "cards").filter("hdu = 0") for p in (a, b)]
    assert {(r["keyword"], r["what"]) for r in diff.headers(*cards).collect()} == {("OBJECT", "changed"), ("ONLY", "only_in_a")}
    pix = [fits.read(spark, p, "image") for p in (a, b)]
    rows = diff.cells(*pix, ["idx"], "value").collect()
    assert [(r["idx"], r["data_total"]) for r in rows] == [(5, 1)]


def test_broken_files():
    for raw in (b"", b"x" * 2880, ct.hdu_bytes(*ct.image_hdu(np.zeros((400, 40))))[:5760]):
        with pytest.raises(ct.FormatError):
            ct.walk(raw)
