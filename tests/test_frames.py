"""Frames with plans of their own give what their SQL says; checks of order."""

import math

import pytest
from pyspark.sql import functions as F

from astrolane.operators.order import falls, first_with_total
from astrolane.plans import catalog
from astrolane.plans.frames import FRAMES, _atan2

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(FRAMES))
def test_frame_equals_flow(spark, name):
    flow = catalog.flows()[name].frame(spark, SF)
    own = catalog.queries()[name](spark, SF)
    assert [(f.name, f.dataType) for f in own.schema] == [(f.name, f.dataType) for f in flow.schema]
    a, b = ([tuple(r) for r in f.collect()] for f in (own, flow))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert x == pytest.approx(y, abs=2e-6, nan_ok=True)


def test_falls(spark):
    rows = [(k, None if k % 11 == 0 else float(k * 7 % 13)) for k in range(500)]
    frame = spark.createDataFrame(rows, "k long, v double").repartition(5)
    want = sum(a is not None and b is not None and b < a for (_, a), (_, b) in zip(rows, rows[1:], strict=False))
    assert [r["down"] for r in falls(frame, "k", "v").collect()] == [want]
    assert falls(frame.limit(0), "k", "v").first()["down"] == 0


def test_first_with_total(spark):
    got = first_with_total(spark.range(100).select(F.col("id").alias("k")), "k", 3).collect()
    assert [(r["k"], r["total"]) for r in got] == [(0, 100), (1, 100), (2, 100)]


def test_prefix_join_rounds_as_its_sql(spark, tmp_path):
    """Pairs of price and value as DuckDB gives them for the SQL, all with the prefix u but for the last three."""
    u = [(954.5, 0.000955), (979.5, 0.000979), (984.5, 0.000984), (989.5, 0.000989), (992.5, 0.000992), (997.5, 0.000997), (-989.5, -0.000989), (0.5, 0.000001), (-0.25, 0.0), (None, None), (float("nan"), None), (float("-inf"), float("-inf"))]
    other = [(0, 1234.5675, 1234567.5), (1, 1.7e300, 1.7e306), (2, 0.0125, 0.000013)]
    rows = [(k, 3, p) for k, (p, _) in enumerate(u)] + [(len(u) + k, size, p) for k, (size, p, _) in enumerate(other)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(6).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    got = catalog.queries()["prefix_join"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    assert [r["p_partkey"] for r in got] == list(range(len(rows)))
    assert [str(r["v"]) for r in got] == [str(v) for v in [v for _, v in u] + [v for *_, v in other]]


def test_celestial_to_native_latpole_turns_as_its_sql(spark, tmp_path):
    """Keys on the meridian where longitudes turn, beside it and at the poles, with longitude and latitude as DuckDB gives them for the SQL."""
    want = {
        (781, 479): (-180.0, -0.42426), (1754, 616): (-180.0, -0.28284), (2727, 753): (-180.0, -0.14142), (100, 890): (180.0, 0.0), (252100, 890): (180.0, 0.0), (1900, -70): (180.0, 0.0), (1073, 1027): (180.0, 0.14142), (2046, 1164): (180.0, 0.28284), (3019, 1301): (180.0, 0.42426),
        (2800, 1540): (180.0, -90.0), (1000, 240): (0.0, 90.0), (-1700, 890): (0.0, 0.0), (1900, 890): (0.0, 0.0), (-100, 890): (165.56724, -13.99545), (None, 890): (None, None), (100, None): (None, None),
    }
    rows = [(o, p, k) for k, (o, p) in enumerate(want)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["celestial_to_native_latpole"](spark, str(tmp_path)).orderBy("l_linenumber").collect()
    assert [tuple(r) for r in got] == [(o, k, *want[o, p]) for o, p, k in rows]


def test_atan2_next_to_the_y_axis(spark):
    pairs = [(s * y, x) for s in (1, -1) for y in (1.0, 0.3, 8e-17) for x in (0.0, 2.2e-16 * y, -2.164890140588733e-16 * y, 1e-12 * y, -9.9e-9 * y)]
    other = [(0.0, 0.0), (0.0, -1.0), (0.0, 2.0), (3.0, 4.0), (-3.0, -4.0), (5e-324, 0.0), (math.inf, 1.0), (-math.inf, -1.0), (1.0, -math.inf)]
    frame = spark.createDataFrame([(k, y, x) for k, (y, x) in enumerate(pairs + other)], "k int, y double, x double")
    got = [r["a"] for r in frame.selectExpr("k", f"{_atan2('y', 'x')} as a").orderBy("k").collect()]
    assert got[: len(pairs)] == [math.atan2(y, x) for y, x in pairs]
    assert got[len(pairs) :] == pytest.approx([math.atan2(y, x) for y, x in other], rel=1e-15)
    nan = spark.createDataFrame([(math.nan, 1.0), (1.0, math.nan), (math.nan, math.nan)], "y double, x double")
    assert all(math.isnan(r["a"]) for r in nan.selectExpr(f"{_atan2('y', 'x')} as a").collect())
