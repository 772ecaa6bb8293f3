"""Header cards as a frame: parsing, merging, lookup, validation and fixes, for any table that holds cards.

The frame of cards has (hdu key columns), pos and card, an 80-character text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolane.sources.container import STRUCTURAL

_VALUE = r"^ *('((?:[^']|'')*)' *|[^'/][^/]*|)(?:/(.*))?$"


def explode_header(df: DataFrame, column: str) -> DataFrame:
    """One row for each 80-character card of a header text, up to END."""
    n = F.floor(F.length(column) / 80)
    cards = df.select(*(c for c in df.columns if c != column), F.posexplode(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(F.col(column), i * 80 + 1, F.lit(80)))).alias("pos", "card"))
    keys = [c for c in df.columns if c != column]
    end = F.min(F.when(F.rtrim("card") == "END", F.col("pos"))).over(Window.partitionBy(*keys)) if keys else F.min(F.when(F.rtrim("card") == "END", F.col("pos"))).over(Window.partitionBy(F.lit(0)))
    return cards.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).drop("_end")


def parse(df: DataFrame) -> DataFrame:
    """Adds keyword, body, vtype, s, l, d, b, unit and comment."""
    h = F.col("card").startswith("HIERARCH ")
    df = df.withColumns({"keyword": F.when(h, F.trim(F.regexp_extract("card", "^HIERARCH ([^=]*)=", 1))).otherwise(F.rtrim(F.substring("card", 1, 8))), "body": F.when(h, F.regexp_extract("card", "^HIERARCH [^=]*=(.*)$", 1)).when(F.substring("card", 9, 2) == "= ", F.expr("substring(card, 11)"))})
    df = df.withColumns({"_q": F.regexp_extract("body", _VALUE, 1), "_t": F.regexp_extract("body", _VALUE, 2), "comment": F.trim(F.regexp_extract("body", _VALUE, 3))}).withColumn("_p", F.trim("_q"))
    kind = F.when(F.col("body").isNull(), "commentary").when(F.col("_p").startswith("'"), "string").when(F.col("_p").isin("T", "F"), "logical").when(F.col("_p") == "", "undefined").when(F.col("_p").rlike(r"^[+-]?\d+$"), "integer").when(F.col("_p").startswith("("), "complex").otherwise("real")
    df = df.withColumn("vtype", kind)
    number = F.expr("try_cast(translate(_p, 'Dd', 'Ee') as double)")
    df = df.withColumns({"s": F.when(F.col("vtype") == "string", F.rtrim(F.regexp_replace("_t", "''", "'"))), "l": F.when(F.col("vtype") == "integer", F.expr("try_cast(_p as bigint)")), "d": F.when(F.col("vtype").isin("integer", "real"), number), "b": F.when(F.col("vtype") == "logical", F.col("_p") == "T"), "unit": F.nullif(F.regexp_extract("comment", r"^\s*\[([^\]]*)\]", 1), F.lit(""))})
    return df.withColumn("vtype", F.when((F.col("vtype") == "real") & F.col("d").isNull(), "unparsed").otherwise(F.col("vtype"))).drop("_q", "_t", "_p")


def merge_continue(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long strings put together: a CONTINUE card joins the card before it where that ends with an ampersand."""
    w = Window.partitionBy(*keys).orderBy("pos")
    piece = F.when(F.col("keyword") == "CONTINUE", F.regexp_replace(F.regexp_extract(F.expr("substring(card, 9)"), _VALUE, 2), "''", "'")).otherwise(F.col("s"))
    open_ = F.coalesce(F.lag(piece).over(w).endswith("&"), F.lit(False))
    df = df.withColumn("_piece", piece).withColumn("_joins", (F.col("keyword") == "CONTINUE") & open_)
    df = df.withColumn("_group", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_piece"))), lambda x: F.regexp_replace(x["_piece"], "&$", ""))
    merged = df.groupBy(*keys, "_group").agg(F.min("pos").alias("pos"), F.min_by("keyword", "pos").alias("keyword"), F.min_by("vtype", "pos").alias("vtype"), F.count(F.lit(1)).alias("_n"), parts.alias("_parts"), F.min_by("s", "pos").alias("_s"), *(F.min_by(c, "pos").alias(c) for c in ("l", "d", "b", "comment", "unit")))
    return merged.withColumn("s", F.when(F.col("_n") > 1, F.array_join("_parts", "")).otherwise(F.col("_s"))).drop("_group", "_parts", "_n", "_s")


def first(df: DataFrame, keys: list[str], keyword: str, column: str) -> DataFrame:
    """The first value of a keyword; one with a dash also answers for its form with an underscore, not the other way."""
    want = [keyword.upper()] + ([keyword.upper().replace("-", "_")] if "-" in keyword else [])
    found = df.filter(F.col("keyword").isin(*want) & (F.col("vtype") != "commentary"))
    return found.groupBy(*keys).agg(F.min_by(column, F.struct(*(F.when(F.col("keyword") == want[0], 0).otherwise(1).alias("o"), F.col("pos")))).alias(keyword))


def pivot(df: DataFrame, keys: list[str], wanted: dict[str, str]) -> DataFrame:
    """First values of reserved keywords as columns. wanted: keyword to value column (s, l, d or b)."""
    return df.filter(F.col("keyword").isin(*wanted)).groupBy(*keys).agg(*(F.min_by(F.when(F.col("keyword") == k, F.col(c)), F.when(F.col("keyword") == k, F.col("pos"))).alias(k) for k, c in wanted.items()))


def inherit(child: DataFrame, primary: DataFrame, keys: list[str]) -> DataFrame:
    """Cards of units with INHERIT = T, and the primary's that they lack and that say nothing of structure. keys: file columns, then the unit's."""
    file_keys = keys[:-1]
    heirs = child.filter((F.col("keyword") == "INHERIT") & F.col("b")).select(*keys).distinct()
    given = primary.filter((F.col("vtype") != "commentary") & ~F.col("keyword").rlike(f"^(?:{STRUCTURAL.pattern})$")).drop(keys[-1])
    if not file_keys:
        raise ValueError("keys name the file's columns before the unit's")
    offered = heirs.join(given, file_keys)
    return child.unionByName(offered.join(child.select(*keys, "keyword").distinct(), [*keys, "keyword"], "left_anti").select(*child.columns))


#: Keywords that observations should have.
RECOMMENDED = ("DATE-OBS", "TELESCOP", "INSTRUME", "OBJECT")


def validate(cards: DataFrame, keys: list[str]) -> DataFrame:
    """keyword, level, message and fix of what breaks a rule; one scan of the cards and one aggregate a unit."""
    one = lambda cond, level, message, fix=None, new=None: F.when(cond, F.struct(F.col("keyword"), F.lit(level).alias("level"), F.lit(message).alias("message"), F.lit(fix).alias("fix"), (new if new is not None else F.lit(None)).cast("string").alias("value")))
    k = F.col("keyword")
    old = F.regexp_extract("s", r"^(\d{2})/(\d{2})/(\d{2})$", 0) != ""
    year = F.expr("case when cast(substring(s, 7, 2) as int) >= 70 then concat('19', substring(s, 7, 2)) else concat('20', substring(s, 7, 2)) end")
    rules = [
        one(k == "EPOCH", "warning", "EPOCH is now EQUINOX", "rename", F.lit("EQUINOX")),
        one(k == "RADECSYS", "warning", "RADECSYS is now RADESYS", "rename", F.lit("RADESYS")),
        one(k.rlike("^CROTA[0-9]+$"), "info", "CROTAn is the old form of PC"),
        one((k == "DATE-OBS") & old, "warning", "DD/MM/YY date", "set", F.concat_ws("-", year, F.expr("substring(s, 4, 2)"), F.expr("substring(s, 1, 2)"))),
        one((k == "EXPTIME") & (F.col("vtype") == "string"), "warning", "EXPTIME is a text", "set", F.col("s")),
        one((k == "PCOUNT") & (F.coalesce(F.col("l"), F.lit(-1)) < 0), "error", "PCOUNT is no count"),
        one((k == "GCOUNT") & (F.coalesce(F.col("l"), F.lit(0)) < 1), "error", "GCOUNT is no count"),
        one(F.col("vtype") == "unparsed", "error", "no value"),
    ]
    each = cards.select(*keys, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r")).select(*keys, "r.*")
    shape = cards.groupBy(*keys).agg(F.collect_set("keyword").alias("have"), F.max(F.when(k == "BITPIX", F.col("l"))).alias("bitpix"), F.max(F.when(k == "NAXIS", F.col("l"))).alias("naxis"), F.min(F.when(k == "BITPIX", F.col("pos"))).alias("p1"), F.min(F.when(k == "NAXIS", F.col("pos"))).alias("p2"))
    need = lambda name, level, message, cond, fix=None: F.when(cond, F.struct(F.lit(name).alias("keyword"), F.lit(level).alias("level"), F.lit(message).alias("message"), F.lit(fix).alias("fix"), F.lit(None).cast("string").alias("value")))
    whole = [
        need("BITPIX", "error", "BITPIX is missing", F.col("bitpix").isNull()),
        need("NAXIS", "error", "NAXIS is missing", F.col("naxis").isNull()),
        need("BITPIX", "error", "mandatory cards are out of order", F.col("p1") > F.col("p2")),
        need("BLANK", "warning", "BLANK means nothing for real pixels", (F.col("bitpix") < 0) & F.array_contains("have", "BLANK"), "remove"),
        need("NAXISn", "error", "an axis length is missing", F.exists(F.sequence(F.lit(1), F.greatest(F.coalesce("naxis", F.lit(0)), F.lit(1)).cast("int")), lambda i: (i <= F.col("naxis")) & ~F.array_contains("have", F.concat(F.lit("NAXIS"), i.cast("string"))))),
        *(need(r, "info", f"{r} is recommended", ~F.array_contains("have", r) & F.array_contains("have", "SIMPLE")) for r in RECOMMENDED),
    ]
    units = shape.select(*keys, F.explode(F.filter(F.array(*whole), lambda r: r.isNotNull())).alias("r")).select(*keys, "r.*")
    return each.unionByName(units)


def fix(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Cards with the fixes of validate applied."""
    found = validate(cards, keys).filter("fix is not null").groupBy(*keys, "keyword").agg(F.first("fix").alias("_fix"), F.first("value").alias("_value"))
    out = cards.join(found, [*keys, "keyword"], "left").filter("_fix is null or _fix <> 'remove'")
    return out.withColumns({"keyword": F.when(F.col("_fix") == "rename", F.col("_value")).otherwise(F.col("keyword")), "s": F.when(F.col("_fix") == "set", F.col("_value")).otherwise(F.col("s")), "vtype": F.when((F.col("_fix") == "set") & (F.col("keyword") == "EXPTIME"), "real").otherwise(F.col("vtype")), "d": F.when((F.col("_fix") == "set") & (F.col("keyword") == "EXPTIME"), F.expr("try_cast(_value as double)")).otherwise(F.col("d"))}).drop("_fix", "_value").select(*cards.columns)


def observatory(values: dict) -> dict | None:
    """ECEF and geodetic position of a header: OBSGEO-X/Y/Z, else -B/L/H or LAT/LONG/ALT names."""
    import math

    from astrolane.functions.geodesy import EP2, A, B, E2

    if all(f"OBSGEO-{a}" in values for a in "XYZ"):
        x, y, z = (float(values[f"OBSGEO-{a}"]) for a in "XYZ")
    else:
        pick = lambda names: next((float(values[n]) for n in names if n in values), None)
        lat, lon, h = pick(("OBSGEO-B", "LAT-OBS", "SITELAT", "LATITUDE")), pick(("OBSGEO-L", "LONG-OBS", "SITELONG", "LONGITUD")), pick(("OBSGEO-H", "ALT-OBS", "SITEELEV", "ALTITUDE")) or 0.0
        if lat is None or lon is None:
            return None
        s, c = math.sin(math.radians(lat)), math.cos(math.radians(lat))
        n = A / math.sqrt(1 - E2 * s * s)
        x, y, z = (n + h) * c * math.cos(math.radians(lon)), (n + h) * c * math.sin(math.radians(lon)), (n * (1 - E2) + h) * s
    p = math.hypot(x, y)
    u = math.atan2(z * A, p * B)
    la = math.atan2(z + EP2 * B * math.sin(u) ** 3, p - E2 * A * math.cos(u) ** 3)
    n = A / math.sqrt(1 - E2 * math.sin(la) ** 2)
    return {"x": x, "y": y, "z": z, "lon": math.degrees(math.atan2(y, x)), "lat": math.degrees(la), "h": p / math.cos(la) - n if p > 1 else abs(z) - B}
