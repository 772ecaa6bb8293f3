"""The ``fits`` data source: header-data units, cards, pixels, table rows, groups and tiles as rows; tables as files.

    spark.dataSource.register(FitsSource)
    spark.read.format("fits").option("mode", "image").option("hdu", "1").load(path)

Modes: ``hdus`` (one row a unit), ``cards``, ``image`` (a row a pixel: x, y, z,
idx, raw, value), ``strips`` (a row for each line of pixels), ``table`` (binary and
text tables, typed columns), ``groups`` and ``tiles`` (a row a decoded tile).
Headers are read on the driver for the schema; data are read where a partition
runs, a slice of rows, lines or tiles each.  Range filters on x, y and row reach
the reader, which then reads and decodes those lines only; Spark applies them
again, so a filter that is not understood costs nothing but time.
"""

from __future__ import annotations

import glob
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from astrolane.session import ship
from astrolane.sources import container as ct

SCHEMAS = {
    "hdus": "path string, hdu int, kind string, extname string, extver int, bitpix int, axes array<bigint>, header_start bigint, data_start bigint, data_len bigint",
    "cards": "path string, hdu int, pos int, keyword string, kind string, vtype string, s string, l bigint, d double, b boolean, comment string",
    "image": "path string, hdu int, idx bigint, x bigint, y bigint, z bigint, raw double, value double",
    "strips": "path string, hdu int, y bigint, z bigint, value array<double>",
    "groups": "path string, hdu int, g bigint, params array<double>, data array<double>",
    "tiles": "path string, hdu int, tile int, origin array<bigint>, shape array<bigint>, value array<double>",
}


def expand(path: str) -> list[str]:
    """Files of a path, a folder or a pattern."""
    if "://" in path and not path.startswith("file://"):
        where, name = ct.pafs.FileSystem.from_uri(path)
        info = where.get_file_info(name)
        if info.is_file:
            return [path]
        scheme = path.split("://")[0]
        return sorted(f"{scheme}://{i.path}" for i in where.get_file_info(ct.pafs.FileSelector(name, recursive=True)) if i.is_file)
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{path}/**/*", recursive=True) if os.path.isfile(p))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


@dataclass
class Slice(InputPartition):
    path: str
    hdu: int
    first: int
    last: int
    box: dict = field(default_factory=dict)


class FitsReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options
        self.mode = options.get("mode", "hdus")
        self.box: dict[str, list[float]] = {}

    def pushFilters(self, filters):  # noqa: N802
        """Ranges of x, y, z and row narrow what is read; every filter is also left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("x", "y", "z", "_row") and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                lo, hi = self.box.setdefault(name, [-math.inf, math.inf])
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.box[name][0] = max(lo, f.value)
                else:
                    self.box[name][1] = min(hi, f.value)
            yield f

    def _wanted(self, units: list[ct.Hdu]) -> list[ct.Hdu]:
        want = self.options.get("hdu")
        name, version = self.options.get("extname"), int(self.options.get("extver", 1))
        if name is not None:
            return [u for u in units if u.name == name and u.version == version][:1]
        if want is not None and want.lstrip("-").isdigit():
            return [u for u in units if u.index == int(want)]
        kinds = {"image": ("image", "compressed"), "strips": ("image", "compressed"), "table": ("bintable", "ascii"), "groups": ("groups",), "tiles": ("compressed",)}.get(self.mode)
        found = [u for u in units if kinds is None or u.kind in kinds and (u.kind != "image" or u.data_len)]
        return found[:1] if self.mode == "table" else found

    def partitions(self):
        rows = int(self.options.get("rowsPerPartition", 1 << 16))
        out = []
        for path in expand(self.options["path"]):
            if self.mode in ("hdus", "cards"):
                out.append(Slice(path, -1, 0, 0))
                continue
            for u in self._wanted(ct.walk(ct.read_file(path), self._lenient, with_data=False)):
                if self.mode in ("image", "strips"):
                    axes = ct.tile_grid(u.header)[0] if u.kind == "compressed" else u.axes
                    n, step = math.prod(axes[1:]) if axes else 0, max(1, rows // max(1, axes[0] if axes else 1))
                elif self.mode == "groups":
                    n, step = int(u.header.get("GCOUNT", 1)), rows
                else:
                    n, step = int(u.header["NAXIS2"]), rows if self.mode == "table" else max(1, rows // 1024)
                out += [Slice(path, u.index, a, min(n, a + step), dict(self.box)) for a in range(0, n, step)]
        return out or [Slice("", -1, 0, 0)]

    @property
    def _lenient(self) -> bool:
        return self.options.get("lenient", "true").lower() != "false"

    def read(self, part: Slice) -> Iterator[tuple]:
        if not part.path:
            return
        units = ct.walk(ct.read_file(part.path), self._lenient)
        if part.hdu < 0:
            for u in units:
                yield from self._meta(part.path, u)
            return
        yield from getattr(self, "_" + self.mode)(part, units[part.hdu])

    def _meta(self, path: str, u: ct.Hdu) -> Iterator[tuple]:
        if self.mode == "hdus":
            yield path, u.index, u.kind, u.name, u.version, int(u.header["BITPIX"]), u.axes, u.start, u.data_start, u.data_len
            return
        for pos, c in enumerate(u.header.cards):
            v = c.value
            kind = "undefined" if v is None else "logical" if isinstance(v, bool) else "integer" if isinstance(v, int) else "real" if isinstance(v, float) else "complex" if isinstance(v, complex) else "string"
            whole = v if kind == "integer" and -(1 << 63) <= v < 1 << 63 else None
            yield path, u.index, pos, c.keyword, c.kind, kind if c.kind == "value" else c.kind, None if v is None else str(v), whole, float(v) if kind in ("integer", "real") else None, v if kind == "logical" else None, c.comment

    def _lines(self, part: Slice, u: ct.Hdu):
        """y, z, stored and physical pixels of each line in the slice and the box."""
        if u.kind == "compressed":
            stored, h = ct.decompress(u), ct.image_header_of(u.header)
            axes = ct.tile_grid(u.header)[0]
        else:
            stored, h, axes = ct.image_raw(u.header, u.raw), u.header, u.axes
        flat = stored.reshape(-1, axes[0])
        inside = lambda name, v: part.box.get(name, (-math.inf, math.inf))[0] <= v <= part.box.get(name, (-math.inf, math.inf))[1]
        ny = axes[1] if len(axes) > 1 else 1
        for line in range(part.first, part.last):
            y, z = line % ny, line // ny
            if inside("y", y) and inside("z", z):
                yield line, y, z, flat[line], ct.physical(h, flat[line])

    def _image(self, part: Slice, u: ct.Hdu) -> Iterator[tuple]:
        lo, hi = part.box.get("x", (-math.inf, math.inf))
        for line, y, z, raw, value in self._lines(part, u):
            a, b = max(0, math.ceil(lo) if lo > -math.inf else 0), min(len(raw) - 1, math.floor(hi) if hi < math.inf else len(raw) - 1)
            for x in range(a, b + 1):
                yield part.path, u.index, line * len(raw) + x, x, y, z, float(raw[x]), float(value[x])

    def _strips(self, part: Slice, u: ct.Hdu) -> Iterator[tuple]:
        for _, y, z, _, value in self._lines(part, u):
            yield part.path, u.index, y, z, [float(v) for v in value]

    def _table(self, part: Slice, u: ct.Hdu) -> Iterator[tuple]:
        if u.kind == "ascii":
            for r in list(ct.ascii_rows(u))[part.first : part.last]:
                yield tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for v, f in zip(r, self.schema.fields, strict=True))
        else:
            yield from ct.bintable_rows(u, part.first, part.last)

    def _groups(self, part: Slice, u: ct.Hdu) -> Iterator[tuple]:
        for g, params, data in ct.group_rows(u):
            if part.first <= g < part.last:
                yield part.path, u.index, g, params, data

    def _tiles(self, part: Slice, u: ct.Hdu) -> Iterator[tuple]:
        names = [c.name for c in ct.columns(u.header)]
        h = ct.image_header_of(u.header)
        for k, cells in enumerate(ct.bintable_rows(u, part.first, part.last)):
            origin, a = ct.decode_tile(u.header, part.first + k, dict(zip(names, cells, strict=True)))
            yield part.path, u.index, part.first + k, list(origin), list(a.shape[::-1]), [float(v) for v in ct.physical(h, a).ravel()]


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class FitsWriter(DataSourceWriter):
    """Rows as one binary table behind an empty primary unit: parts beside the target, joined in order at commit."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite
        self.target = options["path"].removeprefix("file://")
        if os.path.exists(self.target) and not overwrite:
            raise FileExistsError(self.target)
        self.forms = [form_of(f, int(options.get(f"width.{f.name}", options.get("width", 32)))) for f in schema.fields]

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        t = TaskContext.get()
        path, n = f"{self.target}.part-{t.partitionId():06d}-{t.taskAttemptId()}", 0
        with open(path, "wb") as out:
            for row in iterator:
                out.write(b"".join(encode(v, f) for v, f in zip(row, self.forms, strict=True)))
                n += 1
        return Part(path, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.path)
        n = sum(p.rows for p in parts)
        cards = {"EXTNAME": self.options["extname"]} if "extname" in self.options else {}
        for i, f in enumerate(self.schema.fields, 1):
            if (null := NULLS.get(self.forms[i - 1][-1])) is not None and f.nullable and self.forms[i - 1][-1] in "IJK":
                cards[f"TNULL{i}"] = null
        h, _ = ct.table_hdu([f.name for f in self.schema.fields], self.forms, b"", n, cards=cards)
        temp, size = f"{self.target}.tmp", 0
        with open(temp, "wb") as out:
            out.write(ct.hdu_bytes(*ct.image_hdu(None)))
            out.write(h.to_bytes())
            for p in parts:
                with open(p.path, "rb") as f:
                    while chunk := f.read(1 << 20):
                        size += len(chunk)
                        out.write(chunk)
            out.write(b"\0" * (-size % ct.BLOCK))
        os.replace(temp, self.target)
        for p in parts:
            os.remove(p.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


NULLS = {"I": -32768, "J": -2147483648, "K": -(1 << 63)}


def form_of(f: T.StructField, width: int) -> str:
    t = f.dataType
    kinds = {T.BooleanType: "1L", T.ByteType: "1I", T.ShortType: "1I", T.IntegerType: "1J", T.LongType: "1K", T.FloatType: "1E", T.DoubleType: "1D"}
    if type(t) in kinds:
        return kinds[type(t)]
    if isinstance(t, T.StringType):
        return f"{width}A"
    raise ct.FormatError(f"column {f.name}: {t.simpleString()} has no table form")


def encode(v, form: str) -> bytes:
    code = form[-1]
    if code == "L":
        return b"\0" if v is None else b"T" if v else b"F"
    if code == "A":
        raw = (v or "").encode("ascii")
        if len(raw) > int(form[:-1]):
            raise ct.FormatError(f"a text of {len(raw)} bytes in a column of {form}")
        return raw.ljust(int(form[:-1]), b"\0")
    if code in "ED":
        return np.array(np.nan if v is None else v, dtype=">f4" if code == "E" else ">f8").tobytes()
    return np.array(NULLS[code] if v is None else v, dtype={"I": ">i2", "J": ">i4", "K": ">i8"}[code]).tobytes()


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self):
        mode = self.options.get("mode", "hdus")
        if mode in SCHEMAS:
            return SCHEMAS[mode]
        path = expand(self.options["path"])[0]
        reader = FitsReader(None, dict(self.options))
        found = reader._wanted(ct.walk(ct.read_file(path), with_data=False))
        if not found:
            raise ct.FormatError("no table there")
        u = found[0]
        if u.kind == "ascii":
            kind = lambda c: "string" if c[1] == "A" else "bigint" if c[1] == "I" and (c[5], c[6]) == (1.0, 0.0) else "double"
            return ", ".join(f"`{c[0]}` {kind(c)}" for c in ct.ascii_columns(u.header))
        return ", ".join(f"`{c.name}` {ct.spark_type(c)}" for c in ct.columns(u.header))

    def reader(self, schema):
        return FitsReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return FitsWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FitsSource)


def read(spark: SparkSession, path: str, mode: str = "hdus", **options) -> DataFrame:
    register(spark)
    r = spark.read.format("fits").option("mode", mode)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False, extname: str | None = None) -> None:
    """df as one table file; text columns get the width of their longest text."""
    register(df.sparkSession)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    w = df.write.format("fits").mode("overwrite" if overwrite else "append")
    if texts:
        widths = df.agg(*(F.coalesce(F.max(F.octet_length(t)), F.lit(1)).alias(t) for t in texts)).first()
        for t in texts:
            w = w.option(f"width.{t}", str(max(1, widths[t])))
    if extname:
        w = w.option("extname", extname)
    if not overwrite and os.path.exists(path.removeprefix("file://")):
        raise FileExistsError(path)
    w.save(path)
