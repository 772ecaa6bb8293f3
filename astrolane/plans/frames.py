"""Frames of queries that have a better plan than the one that their SQL spells out, or that Spark has to spell otherwise to give what it says."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.functions import timescale
from astrolane.functions.projections import mollweide_fast
from astrolane.operators.order import falls, first_with_total
from astrolane.stages import Flow, apply, num


def leap_asof(flow: Flow, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's step function instead of a join with intervals."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("50000 + event_id % 9000").alias("m"))
    return apply(events, [{"leap": f"cast({timescale.tai_minus_utc('m')} as int)"}])


def first_n_with_total(flow: Flow, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows before the windows of the flow, by top-k and a count."""
    rows = Flow(flow.table, flow.steps[:-3]).frame(spark, sf_dir)
    return first_with_total(rows.select("k", "a", "b"), "k", 10)


def monotone_check(flow: Flow, spark: SparkSession, sf_dir: str) -> DataFrame:
    return falls(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_retailprice").select((F.col("down") == 0).alias("rising"))


def proj_mol_s2x(flow: Flow, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps from a good start instead of 24."""
    at = next(k for k, (kind, x, *_) in enumerate(flow.steps) if kind == "let" and "_v" in x)
    rows = Flow(flow.table, flow.steps[:at]).frame(spark, sf_dir)
    return Flow(flow.table, flow.steps[-1:]).on(apply(rows, mollweide_fast("phi", "theta", "x", "y")))


def _rounded(e: str, digits: int) -> str:
    """``catalog.clean`` with the rounding of engines that scale the double first: a tie is one of the scaled double, where Spark's own round takes the shortest decimal text of the unscaled one. What overflows when scaled stays."""
    scaled = f"({e}) * 1e{digits}"
    return f"case when isnan({e}) then null when abs({scaled}) = {num(math.inf)} then {e} else round({scaled}, 0) / 1e{digits} + 0.0 end"


def prefix_join(flow: Flow, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices times 1e-6 are often ties at the sixth decimal, which have to fall as the SQL's round lets them."""
    return Flow(flow.table, flow.steps[:-1]).select(p_partkey="p_partkey", v=_rounded("p_retailprice * f", 6)).frame(spark, sf_dir)


def _atan2(y: str, x: str) -> str:
    """The nearest double next to the y axis, where Java's atan2 can be off in the last place; of the series in x / y, what follows the first term is below 1e-24 there."""
    near = f"sign({y}) * {num(math.pi / 2)} + (sign({y}) * {num(6.123233995736766e-17)} - {x} / {y})"
    return f"case when abs({x}) < 1e-8 * abs({y}) then {near} else atan2({y}, {x}) end"


def celestial_to_native_latpole(flow: Flow, spark: SparkSession, sf_dir: str) -> DataFrame:
    """LONPOLE is 90, so the y axis is where longitudes turn from 180 to -180, and the last place of the angle says which of them a position on it has."""
    at = next(k for k, (kind, x, *_) in enumerate(flow.steps) if kind == "let" and "_rl" in x)
    turned = {n: e.replace("atan2(_uy, _ux)", _atan2("_uy", "_ux")) for n, e in flow.steps[at][1].items()}
    return Flow(flow.table, (*flow.steps[:at], ("let", turned), *flow.steps[at + 1 :])).frame(spark, sf_dir)


FRAMES = {f.__name__: f for f in (leap_asof, first_n_with_total, monotone_check, proj_mol_s2x, prefix_join, celestial_to_native_latpole)}
