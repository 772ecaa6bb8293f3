"""Stages: lists of named SQL expressions, each over what the stages before it made.

A transform of this engine is a list of stages, ``[{name: expression, ...}, ...]``.
Catalyst keeps stages whose results are used more than once as separate
projections inside one whole-stage-codegen span, so trees stay small, where one
nested expression would double at every step.  The expressions keep to functions
that Spark and other SQL engines share; ``Flow`` renders the same plan as a
DataFrame and as the text of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stages = list[dict[str, str]]

NAN = "cast('NaN' as double)"
#: Degrees in a radian.
R = 57.29577951308232
PI = 3.141592653589793

_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d*|\.\d+)(?![\w.])")
_QUOTED = re.compile(r"('(?:[^']|'')*')")


def num(x: float) -> str:
    """A double literal."""
    x = float(x)
    if x != x:
        return NAN
    if x in (float("inf"), float("-inf")):
        return f"cast('{'-' if x < 0 else ''}Infinity' as double)"
    s = repr(x)
    s = s if "e" in s else s + "e0"
    return f"({s})" if x < 0 else s


def doubles(sql: str) -> str:
    """Decimal literals as doubles, outside of quotes."""
    return "".join(p if p.startswith("'") else _DECIMAL.sub(r"\1e0", p) for p in _QUOTED.split(sql))


def sind(e: str) -> str:
    return f"sin(radians({e}))"


def cosd(e: str) -> str:
    return f"cos(radians({e}))"


def tand(e: str) -> str:
    return f"tan(radians({e}))"


def atan2d(y: str, x: str) -> str:
    return f"degrees(atan2({y}, {x}))"


def asind(e: str) -> str:
    """In degrees; rounding beyond 1 by a hair is taken as 1, more is NaN."""
    return f"case when abs({e}) <= 1 then degrees(asin({e})) when abs({e}) <= 1.0000000001 then sign({e}) * 90 else {NAN} end"


def hypot(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def wrap360(e: str) -> str:
    """Into [0, 360)."""
    return f"(({e}) - 360 * floor(({e}) / 360))"


def wrap180(e: str) -> str:
    """Into (-180, 180]."""
    return f"(180 - ((180 - ({e})) - 360 * floor((180 - ({e})) / 360)))"


def when(cond: str, then: str, other: str = NAN) -> str:
    return f"case when {cond} then {then} else {other} end"


def horner(x: str, coeffs: list[float]) -> str:
    """The polynomial of ascending coefficients."""
    out = num(coeffs[-1]) if coeffs else "0e0"
    for c in reversed(coeffs[:-1]):
        out = f"({num(c)} + ({x}) * {out})"
    return out


def compiled(spark: SparkSession) -> None:
    """Generated methods of more than 8000 bytes stay bytecode: the JVM never compiles them. Long chains of stages are then run projection by projection, unless the session says otherwise."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def apply(df: DataFrame, stages: Stages, drop: bool = True) -> DataFrame:
    """df with the columns of the stages; those whose names start with _ are dropped at the end."""
    compiled(df.sparkSession)
    for s in stages:
        df = df.withColumns({n: F.expr(doubles(e)) for n, e in s.items()})
    return df.drop(*{n for s in stages for n in s if n.startswith("_")}) if drop else df


class Flow:
    """One plan, as a DataFrame and as SQL text."""

    def __init__(self, table: str, steps: tuple = ()):
        self.table, self.steps = table, steps

    def _with(self, *step) -> Flow:
        return Flow(self.table, (*self.steps, step))

    def let(self, **exprs: str) -> Flow:
        return self._with("let", exprs)

    def stages(self, stages: Stages) -> Flow:
        out = self
        for s in stages:
            out = out._with("let", s)
        return out

    def where(self, cond: str) -> Flow:
        return self._with("where", cond)

    def select(self, **exprs: str) -> Flow:
        return self._with("select", exprs)

    def agg(self, by: list[str], **exprs: str) -> Flow:
        return self._with("agg", by, exprs)

    def join(self, other: Flow, on: str, how: str = "inner") -> Flow:
        """on: over the columns of both, which must have different names."""
        return self._with("join", other, on, how)

    def union(self, other: Flow) -> Flow:
        """Rows of both, by position; columns of the same names."""
        return self._with("union", other)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.on(spark.read.parquet(f"{sf_dir}/{self.table}.parquet"), sf_dir)

    def on(self, df: DataFrame, sf_dir: str = "") -> DataFrame:
        """The steps over a frame; sf_dir: where the tables that it joins are."""
        spark = df.sparkSession
        compiled(spark)
        for kind, *x in self.steps:
            if kind == "let":
                df = df.withColumns({n: F.expr(doubles(e)) for n, e in x[0].items()})
            elif kind == "where":
                df = df.filter(F.expr(doubles(x[0])))
            elif kind == "select":
                df = df.select(*(F.expr(doubles(e)).alias(n) for n, e in x[0].items()))
            elif kind == "agg":
                df = df.groupBy(*x[0]).agg(*(F.expr(doubles(e)).alias(n) for n, e in x[1].items()))
            elif kind == "join":
                df = df.join(x[0].frame(spark, sf_dir), F.expr(doubles(x[1])), {"semi": "left_semi", "anti": "left_anti"}.get(x[2], x[2]))
            elif kind == "union":
                df = df.union(x[0].frame(spark, sf_dir))
        return df

    def sql(self) -> str:
        parts: list[str] = []
        last = self._sql(parts)
        return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {last}"

    def _sql(self, parts: list[str]) -> str:
        at, have = self.table, set()
        for kind, *x in self.steps:
            if kind == "let":
                old, new = (", ".join(f"{doubles(e)} AS {n}" for n, e in x[0].items() if (n in have) == known) for known in (True, False))
                body = f"SELECT *{f' REPLACE ({old})' if old else ''}{f', {new}' if new else ''} FROM {at}"
                have |= set(x[0])
            elif kind == "where":
                body = f"SELECT * FROM {at} WHERE {doubles(x[0])}"
            elif kind == "select":
                have = set(x[0])
                body = f"SELECT {', '.join(f'{doubles(e)} AS {n}' for n, e in x[0].items())} FROM {at}"
            elif kind == "agg":
                keys, have = ", ".join(x[0]), {*x[0], *x[1]}
                body = f"SELECT {keys + ', ' if keys else ''}{', '.join(f'{doubles(e)} AS {n}' for n, e in x[1].items())} FROM {at}" + (f" GROUP BY {keys}" if keys else "")
            elif kind == "join":
                other = x[0]._sql(parts)
                body = f"SELECT * FROM {at} {x[2].upper().replace('_', ' ').replace('FULL OUTER', 'FULL')} JOIN {other} ON {doubles(x[1])}"
            else:
                body = f"SELECT * FROM {at} UNION ALL SELECT * FROM {x[0]._sql(parts)}"
            at = f"s{len(parts)}"
            parts.append(f"{at} AS ({body})")
        return at
