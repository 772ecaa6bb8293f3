"""The container format, byte by byte: header cards, header-data units, tables, images, groups and tiles."""

from __future__ import annotations

import gzip
import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs as pafs

from astrolane.functions.scaling import Tform
from astrolane.operators import checksum as ck
from astrolane.sources import codecs

BLOCK, CARD = 2880, 80
COMMENTARY = ("COMMENT", "HISTORY", "")
STRUCTURAL = re.compile(r"SIMPLE|XTENSION|BITPIX|NAXIS\d*|EXTEND|PCOUNT|GCOUNT|GROUPS|TFIELDS|THEAP|T(?:FORM|TYPE|UNIT|SCAL|ZERO|NULL|DIM|DISP|BCOL)\d+|EXTNAME|EXTVER|EXTLEVEL|CHECKSUM|DATASUM|INHERIT|END|BSCALE|BZERO|BLANK")


class FormatError(OSError):
    """What a file that breaks the format raises."""


@dataclass
class Card:
    keyword: str
    value: object = None
    comment: str = ""
    #: value, commentary or unparsed
    kind: str = "value"


def parse_value(text: str) -> tuple[object, str]:
    """Value and comment of a value field; None for an undefined one."""
    m = re.match(r"\s*'((?:[^']|'')*)'\s*(?:/(.*))?$", text)
    if m:
        return m[1].replace("''", "'").rstrip() if m[1].strip() or not m[1] else " ", (m[2] or "").strip()
    body, _, comment = text.partition("/")
    body = body.strip()
    if not body:
        return None, comment.strip()
    if body in ("T", "F"):
        return body == "T", comment.strip()
    if re.fullmatch(r"[+-]?\d+", body):
        return int(body), comment.strip()
    if m := re.fullmatch(r"\(\s*([^,]+),\s*([^)]+)\)", body):
        return complex(_real(m[1]), _real(m[2])), comment.strip()
    return _real(body), comment.strip()


def _real(text: str) -> float:
    try:
        return float(text.strip().upper().replace("D", "E"))
    except ValueError:
        raise FormatError(f"no value: {text!r}") from None


def legal(key: str) -> str:
    """A keyword in upper case; eight of A-Z, 0-9, - and _ at most, or printable words for a HIERARCH card."""
    key = key.upper()
    if not re.fullmatch(r"[A-Z0-9_-]{1,8}|[!-<>-~]+( [!-<>-~]+)+|HIERARCH [ -<>-~]+", key):
        raise FormatError(f"no keyword: {key!r}")
    return key.removeprefix("HIERARCH ")


def parse_card(raw: str, lenient: bool = True) -> Card:
    if raw.startswith("HIERARCH ") and "=" in raw:
        key, _, rest = raw[9:].partition("=")
        return _valued(key.strip(), rest, lenient)
    key = raw[:8].rstrip()
    if key in COMMENTARY or raw[8:10] != "= ":
        return Card(key, raw[8:].rstrip(), "", "continue" if key == "CONTINUE" else "commentary")
    return _valued(key, raw[10:], lenient)


def _valued(key: str, rest: str, lenient: bool) -> Card:
    try:
        v, c = parse_value(rest)
        return Card(key, v, c)
    except FormatError:
        if not lenient:
            raise
        return Card(key, rest.strip(), "", "unparsed")


class Header:
    """Cards in order, with lookup of first values."""

    def __init__(self, cards: list[Card] | None = None):
        self.cards = list(cards or [])

    @classmethod
    def parse(cls, raw: bytes, lenient: bool = True) -> Header:
        """80-byte cards up to END; a long string goes on in CONTINUE cards where it ends with an ampersand."""
        out: list[Card] = []
        text = raw.decode("ascii", "replace" if lenient else "strict")
        for at in range(0, len(text) - CARD + 1, CARD):
            line = text[at : at + CARD]
            if line.rstrip() == "END":
                break
            card = parse_card(line, lenient)
            if card.kind == "continue":
                last = out[-1] if out else None
                if last and last.kind == "value" and isinstance(last.value, str) and last.value.endswith("&"):
                    try:
                        more, note = parse_value(str(card.value))
                    except FormatError:
                        more, note = None, ""
                    if isinstance(more, str):
                        last.value = last.value[:-1] + more
                        last.comment = f"{last.comment} {note}".strip()
                        continue
                card.kind = "commentary"
            out.append(card)
        return cls(out)

    def get(self, key: str, default=None):
        """The first value; a keyword with a dash also answers for its form with an underscore."""
        key = key.upper()
        for want in (key, key.replace("-", "_")) if "-" in key else (key,):
            for c in self.cards:
                if c.keyword == want and c.kind == "value":
                    return c.value
        return default

    def __getitem__(self, key: str):
        v = self.get(key, self)
        if v is self:
            raise KeyError(key)
        return v

    def __contains__(self, key: str) -> bool:
        return any(c.keyword == key.upper() and c.kind != "commentary" for c in self.cards)

    def set(self, key: str, value, comment: str | None = None, before: str | None = None, after: str | None = None) -> None:
        key = key.upper()
        for c in self.cards:
            if c.keyword == key and c.kind != "commentary":
                c.value, c.kind = value, "value"
                if comment is not None:
                    c.comment = comment
                return
        at = len(self.cards)
        for k, c in enumerate(self.cards):
            if before and c.keyword == before.upper():
                at = k
                break
            if after and c.keyword == after.upper():
                at = k + 1
                break
        self.cards.insert(at, Card(key, value, comment or ""))

    def remove(self, key: str) -> bool:
        n = len(self.cards)
        self.cards = [c for c in self.cards if c.keyword != key.upper() or c.kind == "commentary"]
        return len(self.cards) < n

    def insert(self, at: int, key: str, value, comment: str | None = None) -> None:
        """A new card at a place, whatever cards of that keyword there are; behind the last one it is appended."""
        self.cards.insert(min(max(at, 0), len(self.cards)), Card(legal(key), value, comment or ""))

    def _place(self, key: str) -> int | None:
        return next((i for i, c in enumerate(self.cards) if c.keyword == key.upper() and c.kind != "commentary"), None)

    def set_before(self, before: str, key: str, value, comment: str | None = None) -> bool:
        """A new card in front of the first one of a keyword; at the end, and False, where there is none."""
        at = self._place(before)
        self.insert(len(self.cards) if at is None else at, key, value, comment)
        return at is not None

    def set_after(self, after: str, key: str, value, comment: str | None = None) -> bool:
        """A new card behind the first one of a keyword; at the end, and False, where there is none."""
        at = self._place(after)
        self.insert(len(self.cards) if at is None else at + 1, key, value, comment)
        return at is not None

    def push_commentary(self, key: str, text: str) -> None:
        if key not in COMMENTARY:
            raise FormatError(f"{key!r} takes no commentary")
        self.cards.append(Card(key, text, "", "commentary"))

    def rename(self, old: str, new: str) -> int:
        """How many cards with values were renamed; commentary stays."""
        found = [c for c in self.cards if c.keyword == old.upper() and c.kind != "commentary"]
        for c in found:
            c.keyword = legal(new)
        return len(found)

    def values(self) -> dict:
        out: dict = {}
        for c in self.cards:
            if c.kind == "value":
                out.setdefault(c.keyword, c.value)
        return out

    def history(self) -> list[str]:
        return [str(c.value) for c in self.cards if c.keyword == "HISTORY"]

    def comments(self) -> list[str]:
        return [str(c.value) for c in self.cards if c.keyword == "COMMENT"]

    def inherit(self, primary: Header) -> Header:
        """With the primary's cards that say nothing of structure and are not here."""
        if self.get("INHERIT") is not True:
            return Header(self.cards)
        return Header(self.cards + [c for c in primary.cards if c.kind == "value" and c.keyword not in self and not STRUCTURAL.fullmatch(c.keyword)])

    def to_bytes(self) -> bytes:
        lines = [x for c in self.cards for x in render(c)]
        raw = "".join(x.ljust(CARD)[:CARD] for x in [*lines, "END"]).encode("ascii", "replace")
        return raw + b" " * (-len(raw) % BLOCK)


def format_value(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool | np.bool_):
        return ("T" if v else "F").rjust(20)
    if isinstance(v, int | np.integer):
        return str(int(v)).rjust(20)
    if isinstance(v, complex):
        return f"({format_value(v.real).strip()}, {format_value(v.imag).strip()})".rjust(20)
    if isinstance(v, float | np.floating):
        if not math.isfinite(v):
            raise FormatError("no card holds a number that is not finite")
        s = repr(float(v)).upper()
        if "E" in s and "." not in s:
            s = s.replace("E", ".0E")
        return s.rjust(20)
    return "'" + str(v).replace("'", "''").ljust(8) + "'"


def render(c: Card) -> list[str]:
    """A card as lines of 80 characters; long strings in several."""
    if c.kind == "commentary":
        text = str(c.value or "")
        return [f"{c.keyword:8}{text[i : i + 72]}" for i in range(0, max(len(text), 1), 72)]
    if c.kind == "unparsed":
        return [f"{c.keyword:8}= {c.value}"]
    head = f"{c.keyword:8}= " if re.fullmatch(r"[A-Z0-9_-]{1,8}", c.keyword) else f"HIERARCH {c.keyword} = "
    value = format_value(c.value)
    if isinstance(c.value, str) and len(head) + len(value) > CARD:
        text, out, first = c.value.replace("'", "''"), [], True
        while text:
            room = 67 if not first else CARD - len(head) - 3
            n = len(text) if len(text) <= room else room - (text[:room].endswith("'") and (room - len(text[:room].rstrip("'"))) % 2)
            piece, text = text[:n], text[n:]
            out.append((head if first else "CONTINUE  ") + f"'{piece}{'&' if text else ''}'")
            first = False
        return out
    line = head + value + (f" / {c.comment}" if c.comment else "")
    return [line[:CARD]]


@dataclass
class Hdu:
    index: int
    header: Header
    start: int
    data_start: int
    data_len: int
    kind: str
    raw: bytes = field(default=b"", repr=False)

    @property
    def axes(self) -> list[int]:
        return [int(self.header.get(f"NAXIS{i}", 0)) for i in range(1, int(self.header.get("NAXIS", 0)) + 1)]

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", "") or "")

    @property
    def version(self) -> int:
        return int(self.header.get("EXTVER", 1) or 1)


def data_size(h: Header) -> int:
    """Bytes of data behind a header."""
    axes = [int(h.get(f"NAXIS{i}", 0)) for i in range(1, int(h.get("NAXIS", 0)) + 1)]
    if any(a < 0 for a in axes):
        raise FormatError("an axis of negative length")
    if not axes:
        return 0
    if h.get("GROUPS") is True and axes[0] == 0:
        axes = axes[1:]
    pc, gc = int(h.get("PCOUNT", 0)), int(h.get("GCOUNT", 1))
    if pc < 0 or gc < 0:
        raise FormatError("a negative count")
    return abs(int(h["BITPIX"])) // 8 * gc * (pc + math.prod(axes))


def kind_of(h: Header, index: int) -> str:
    if index == 0 and "XTENSION" not in h:
        return "groups" if h.get("GROUPS") is True and h.get("NAXIS1") == 0 else "image"
    x = str(h.get("XTENSION", "")).strip()
    if x == "BINTABLE":
        return "compressed" if h.get("ZIMAGE") is True else "bintable"
    return {"IMAGE": "image", "TABLE": "ascii"}.get(x, "conforming")


def read_file(path: str) -> bytes:
    """All bytes of a file of any file system, inflated where they are gzip."""
    where, name = pafs.FileSystem.from_uri(path if "://" in path else "file://" + __import__("os").path.abspath(path.removeprefix("file:")))
    with where.open_input_file(name) as f:
        data = f.read()
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def walk(data: bytes, lenient: bool = True, with_data: bool = True) -> list[Hdu]:
    """The header-data units of a file; zeros or text that starts no unit end it."""
    out, at = [], 0
    while at + BLOCK <= len(data):
        if out and (not data[at : at + BLOCK].strip(b"\0") or not data[at : at + 8].startswith(b"XTENSION")):
            break
        end = at
        while True:
            if end + BLOCK > len(data):
                raise FormatError("a header without END")
            block = data[end : end + BLOCK]
            end += BLOCK
            if any(block[i : i + CARD].rstrip() == b"END" for i in range(0, BLOCK, CARD)):
                break
        h = Header.parse(data[at:end], lenient)
        if not out and "SIMPLE" not in h:
            raise FormatError("no SIMPLE card")
        n = data_size(h)
        if end + n > len(data):
            raise FormatError("the data end early")
        out.append(Hdu(len(out), h, at, end, n, kind_of(h, len(out)), data[end : end + n] if with_data else b""))
        at = end + -(-n // BLOCK) * BLOCK
    if not out:
        raise FormatError("no header-data unit")
    return out


# -- images

DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
UNSIGNED = {8: (-128, np.int8), 16: (32768, np.uint16), 32: (2147483648, np.uint32), 64: (9223372036854775808, np.uint64)}


def image_raw(h: Header, raw: bytes) -> np.ndarray:
    axes = [int(h.get(f"NAXIS{i}", 0)) for i in range(1, int(h.get("NAXIS", 0)) + 1)]
    if not axes or not math.prod(axes):
        return np.zeros(0, dtype=DTYPES[int(h["BITPIX"])])
    return np.frombuffer(raw, dtype=DTYPES[int(h["BITPIX"])], count=math.prod(axes)).reshape(axes[::-1])


def physical(h: Header, stored: np.ndarray) -> np.ndarray:
    """Stored pixels as numbers: as they are, unsigned by convention, or scaled to single or double precision."""
    bitpix, scale, zero, blank = int(h["BITPIX"]), float(h.get("BSCALE", 1.0)), float(h.get("BZERO", 0.0)), h.get("BLANK")
    if bitpix < 0:
        blank = None
    native = stored.astype(stored.dtype.newbyteorder("="))
    if scale == 1 and zero == 0 and blank is None:
        return native
    if scale == 1 and blank is None and bitpix in UNSIGNED and zero == UNSIGNED[bitpix][0]:
        off, kind = UNSIGNED[bitpix]
        return (native.astype(np.int16) + off).astype(kind) if bitpix == 8 else (native.view(kind) ^ kind(1 << bitpix - 1))
    out = native.astype(np.float64) * scale + zero
    if blank is not None:
        out[native == int(blank)] = np.nan
    return out.astype(np.float32) if bitpix in (8, 16, -32) else out


# -- binary tables

@dataclass(frozen=True)
class Column:
    number: int
    name: str
    form: Tform
    offset: int
    scale: float
    zero: float
    null: int | None
    dims: tuple[int, ...]
    unit: str | None = None


def columns(h: Header) -> list[Column]:
    out, at, seen = [], 0, {}
    for i in range(1, int(h.get("TFIELDS", 0)) + 1):
        f = Tform.parse(str(h[f"TFORM{i}"]))
        name = str(h.get(f"TTYPE{i}", "") or "").strip() or f"_c{i}"
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            name = f"{name}_{seen[name]}"
        dims = tuple(int(x) for x in re.findall(r"\d+", str(h.get(f"TDIM{i}", "") or "")))
        null = h.get(f"TNULL{i}")
        out.append(Column(i, name, f, at, float(h.get(f"TSCAL{i}", 1.0)), float(h.get(f"TZERO{i}", 0.0)), int(null) if null is not None else None, dims, h.get(f"TUNIT{i}")))
        at += f.width
    if at > int(h.get("NAXIS1", 0)):
        raise FormatError("columns are wider than a row")
    return out


_NUMPY = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16"}
_SIGNED = {"B": (-128, 8), "I": (32768, 16), "J": (2147483648, 32), "K": (9223372036854775808, 64)}


def spark_type(c: Column) -> str:
    code = c.form.inner or c.form.code
    scaled = (c.scale, c.zero) != (1.0, 0.0)
    uns = c.scale == 1 and code in _SIGNED and c.zero == _SIGNED[code][0]
    base = {"L": "boolean", "X": "boolean", "A": "string", "E": "float", "D": "double", "C": "struct<re:float,im:float>", "M": "struct<re:double,im:double>"}.get(code)
    if base is None:
        base = {"B": "short", "I": "int", "J": "bigint", "K": "decimal(20,0)"}[code] if uns else "double" if scaled else {"B": "short", "I": "short", "J": "int", "K": "bigint"}[code]
    if c.form.inner:
        return f"array<{base}>"
    if code == "A":
        return "array<string>" if len(c.dims) > 1 else "string"
    if code == "X" or c.form.repeat > 1:
        for _ in range(max(1, len(c.dims))):
            base = f"array<{base}>"
    return base


def _text(b: bytes) -> str:
    return b.split(b"\0")[0].decode("latin-1").rstrip(" ")


def _elements(c: Column, code: str, raw: bytes, n: int) -> list:
    """n elements of one cell."""
    if code == "L":
        out = []
        for b in raw[:n]:
            if b not in b"TtFf\0":
                raise FormatError("no logical value")
            out.append(None if b == 0 else b in b"Tt")
        return out
    if code == "X":
        return [bool(x) for x in np.unpackbits(np.frombuffer(raw, dtype=np.uint8))[:n]]
    if code in "CM":
        return [(float(x.real), float(x.imag)) for x in np.frombuffer(raw, dtype=_NUMPY[code], count=n)]
    a = np.frombuffer(raw, dtype=_NUMPY[code], count=n)
    if code in "ED":
        if (c.scale, c.zero) != (1.0, 0.0):
            a = a.astype(np.float32) * np.float32(c.scale) + np.float32(c.zero) if code == "E" else a * c.scale + c.zero
        return [float(x) for x in a]
    whole = [int(x) for x in a]
    if c.scale == 1 and code in _SIGNED and c.zero == _SIGNED[code][0]:
        off = int(c.zero)
        made = [x + off for x in whole]
        if code == "K":
            from decimal import Decimal

            made = [Decimal(x) for x in made]
        return [None if x == c.null else y for x, y in zip(whole, made, strict=True)]
    if (c.scale, c.zero) != (1.0, 0.0):
        return [math.nan if x == c.null else x * c.scale + c.zero for x in whole]
    return [None if x == c.null else x for x in whole]


def _nest(values: list, dims: tuple[int, ...]) -> list:
    for d in dims[:-1]:
        values = [values[i : i + d] for i in range(0, len(values), d)]
    return values


def cell(c: Column, row: bytes, heap: bytes):
    f = c.form
    raw = row[c.offset : c.offset + f.width]
    if f.inner:
        if not f.repeat:
            return []
        n, at = (int(x) for x in np.frombuffer(raw, dtype=">i4" if f.code == "P" else ">i8", count=2))
        if f.inner == "A":
            return [_text(heap[at : at + n])] if n else []
        width = (n + 7) // 8 if f.inner == "X" else n * Tform.BYTES[f.inner]
        if at < 0 or n < 0 or at + width > len(heap):
            raise FormatError("a descriptor points outside the heap")
        return _elements(c, f.inner, heap[at : at + width], n)
    if f.code == "A":
        if len(c.dims) > 1:
            w = c.dims[0]
            return [_text(raw[i : i + w]) for i in range(0, len(raw), w)]
        return _text(raw)
    values = _elements(c, f.code, raw, f.repeat)
    if f.code == "X" or f.repeat > 1:
        return _nest(values, c.dims) if len(c.dims) > 1 else values
    return values[0] if values else None


def heap_of(hdu: Hdu) -> bytes:
    h = hdu.header
    size = int(h["NAXIS1"]) * int(h["NAXIS2"])
    at = int(h.get("THEAP", size))
    if at < size or at > len(hdu.raw):
        raise FormatError("THEAP lies outside the data")
    return hdu.raw[at:]


def bintable_rows(hdu: Hdu, first: int = 0, last: int | None = None):
    cols, w, heap = columns(hdu.header), int(hdu.header["NAXIS1"]), heap_of(hdu)
    for r in range(first, int(hdu.header["NAXIS2"]) if last is None else min(last, int(hdu.header["NAXIS2"]))):
        row = hdu.raw[r * w : (r + 1) * w]
        yield tuple(cell(c, row, heap) for c in cols)


# -- text tables

def ascii_columns(h: Header) -> list[tuple[str, str, int, int, int, float, float, str | None]]:
    """name, code, start, width, decimals, scale, zero, null."""
    out = []
    for i in range(1, int(h.get("TFIELDS", 0)) + 1):
        m = re.fullmatch(r"([AIFED])(\d+)(?:\.(\d+))?", str(h[f"TFORM{i}"]).strip())
        if not m:
            raise FormatError(f"TFORM{i}")
        null = h.get(f"TNULL{i}")
        out.append((str(h.get(f"TTYPE{i}", "") or f"_c{i}").strip(), m[1], int(h[f"TBCOL{i}"]) - 1, int(m[2]), int(m[3] or 0), float(h.get(f"TSCAL{i}", 1.0)), float(h.get(f"TZERO{i}", 0.0)), str(null).strip() if null is not None else None))
    return out


def text_real(t: str, decimals: int) -> float:
    """Blank is 0; a point may be implied, and an exponent may come without a letter."""
    t = t.strip().upper().replace("D", "E")
    if not t:
        return 0.0
    m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))(?:E?([+-]?\d+))?" if "E" in t else r"([+-]?(?:\d+\.?\d*|\.\d+))([+-]\d+)?", t)
    if not m:
        raise FormatError(f"no number: {t!r}")
    v = float(m[1]) * 10.0 ** int(m[2] or 0)
    return v if "." in m[1] else v / 10.0**decimals


def ascii_rows(hdu: Hdu):
    w, cols = int(hdu.header["NAXIS1"]), ascii_columns(hdu.header)
    for r in range(int(hdu.header["NAXIS2"])):
        row = hdu.raw[r * w : (r + 1) * w].decode("latin-1")
        out = []
        for _, code, at, width, dec, scale, zero, null in cols:
            t = row[at : at + width]
            if null is not None and t.strip() == null:
                out.append(None)
            elif code == "A":
                out.append(t.rstrip())
            elif code == "I" and (scale, zero) == (1.0, 0.0):
                out.append(int(t.strip() or 0))
            else:
                out.append((text_real(t, dec) if code != "I" else float(t.strip() or 0)) * scale + zero)
        yield tuple(out)


# -- groups

def group_rows(hdu: Hdu):
    """Group number, physical parameters, data."""
    h = hdu.header
    pc, gc = int(h.get("PCOUNT", 0)), int(h.get("GCOUNT", 1))
    n = math.prod(hdu.axes[1:])
    a = np.frombuffer(hdu.raw, dtype=DTYPES[int(h["BITPIX"])], count=gc * (pc + n)).reshape(gc, pc + n).astype(float)
    scale = [float(h.get(f"PSCAL{i}", 1.0)) for i in range(1, pc + 1)]
    zero = [float(h.get(f"PZERO{i}", 0.0)) for i in range(1, pc + 1)]
    for g in range(gc):
        yield g, [float(p * s + z) for p, s, z in zip(a[g, :pc], scale, zero, strict=True)], [float(x) for x in a[g, pc:] * float(h.get("BSCALE", 1.0)) + float(h.get("BZERO", 0.0))]


def group_parameter(h: Header, params: list[float], name: str) -> float | None:
    """The sum of the parameters of one name; None where there is none."""
    own = [p for i, p in enumerate(params, 1) if str(h.get(f"PTYPE{i}", "")).strip() == name]
    return sum(own) if own else None


# -- tile-compressed images

def tile_grid(h: Header) -> tuple[list[int], list[int]]:
    n = int(h["ZNAXIS"])
    axes = [int(h[f"ZNAXIS{i}"]) for i in range(1, n + 1)]
    return axes, [int(h.get(f"ZTILE{i}", axes[0] if i == 1 else 1)) for i in range(1, n + 1)]


def tile_box(axes: list[int], tile: list[int], row: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Origin and shape of tile number row, fastest axis first."""
    origin, shape = [], []
    for a, t in zip(axes, tile, strict=True):
        n = -(-a // t)
        k = row % n
        row //= n
        origin.append(k * t)
        shape.append(min(t, a - k * t))
    return tuple(origin), tuple(shape)


def decode_tile(h: Header, row: int, cells: dict) -> tuple[tuple[int, ...], np.ndarray]:
    """Origin and pixels of one tile. cells: the tile's table cells by column name."""
    axes, tile = tile_grid(h)
    origin, shape = tile_box(axes, tile, row)
    n, bitpix = math.prod(shape), int(h["ZBITPIX"])
    params = {str(h[f"ZNAME{i}"]).strip(): h.get(f"ZVAL{i}") for i in range(1, 20) if f"ZNAME{i}" in h}
    pick = lambda name: cells.get(name) if cells.get(name) is not None else h.get(name)
    if (data := cells.get("COMPRESSED_DATA")) is not None and len(data):
        raw, codec = bytes(bytearray(x & 255 for x in data)), str(h["ZCMPTYPE"]).strip()
    elif (data := cells.get("UNCOMPRESSED_DATA")) is not None and len(data):
        return origin, np.array(data, dtype=float if bitpix < 0 else np.int64).reshape(shape[::-1])
    else:
        raw, codec = bytes(bytearray(x & 255 for x in cells.get("GZIP_COMPRESSED_DATA") or [])), "GZIP_RAW"
        if not raw:
            raise FormatError("a tile without data")
    scale, zero = pick("ZSCALE"), pick("ZZERO")
    quantized = bitpix < 0 and scale is not None and codec != "GZIP_RAW"
    if codec in ("GZIP_1", "GZIP_2", "GZIP_RAW", "NOCOMPRESS"):
        dtype = np.dtype(">i4" if quantized else DTYPES[bitpix])
        body = raw if codec == "NOCOMPRESS" else codecs.gzip_decode(raw)
        if codec == "GZIP_2":
            body = codecs.unshuffle(body, dtype.itemsize)
        a = np.frombuffer(body, dtype=dtype, count=n)
    elif codec in ("RICE_1", "RICE_ONE"):
        size = int(params.get("BYTEPIX", 4 if bitpix < 0 else abs(bitpix) // 8))
        a = codecs.rice_decode(raw, n, size, int(params.get("BLOCKSIZE", 32)))
    elif codec == "PLIO_1":
        a = codecs.plio_decode(raw, n)
    elif codec == "HCOMPRESS_1":
        a = codecs.hcompress_decode(raw, bool(params.get("SMOOTH", 0)))[0].ravel()
    else:
        raise FormatError(f"codec {codec}")
    if quantized:
        a = codecs.unquantize(np.asarray(a), float(scale), float(zero or 0.0), str(h.get("ZQUANTIZ", "NO_DITHER")).strip(), int(h.get("ZDITHER0", 1)) + row, int(b) if (b := pick("ZBLANK")) is not None else None)
    return origin, np.asarray(a).reshape(shape[::-1])


def tile_rows(hdu: Hdu):
    """For each tile: number, origin, shape, pixels."""
    names = [c.name for c in columns(hdu.header)]
    for row, cells in enumerate(bintable_rows(hdu)):
        origin, a = decode_tile(hdu.header, row, dict(zip(names, cells, strict=True)))
        yield row, origin, a


def image_header_of(h: Header) -> Header:
    """The header of the image that a compressed table holds."""
    out = []
    drop = re.compile(r"XTENSION|BITPIX|NAXIS\d*|PCOUNT|GCOUNT|TFIELDS|T(?:TYPE|FORM|UNIT|DIM|NULL|SCAL|ZERO)\d+|THEAP|ZIMAGE|ZCMPTYPE|ZTILE\d+|ZNAME\d+|ZVAL\d+|ZQUANTIZ|ZDITHER0|ZSIMPLE|ZEXTEND|ZTENSION|ZPCOUNT|ZGCOUNT|ZHECKSUM|ZDATASUM|CHECKSUM|DATASUM|ZBITPIX|ZNAXIS\d*|ZSCALE|ZZERO|ZBLANK")
    axes, _ = tile_grid(h)
    out = [Card("XTENSION", "IMAGE"), Card("BITPIX", int(h["ZBITPIX"])), Card("NAXIS", len(axes)), *(Card(f"NAXIS{i}", a) for i, a in enumerate(axes, 1)), Card("PCOUNT", 0), Card("GCOUNT", 1)]
    return Header(out + [c for c in h.cards if not drop.fullmatch(c.keyword)])


def decompress(hdu: Hdu) -> np.ndarray:
    """The stored pixels of a whole compressed image."""
    axes, _ = tile_grid(hdu.header)
    bitpix = int(hdu.header["ZBITPIX"])
    out = np.zeros(axes[::-1], dtype=np.dtype(DTYPES[bitpix]).newbyteorder("="))
    for _, origin, a in tile_rows(hdu):
        out[tuple(slice(o, o + n) for o, n in zip(origin[::-1], a.shape, strict=True))] = a
    return out


# -- writing

def image_hdu(data: np.ndarray | None, cards: dict | None = None, primary: bool = True) -> tuple[Header, bytes]:
    """Header and data of an image; unsigned integers by the BZERO convention."""
    data = np.zeros(0) if data is None else np.asarray(data)
    zero = None
    if data.dtype == bool:
        data = data.astype(np.uint8)
    for bits, (off, kind) in UNSIGNED.items():
        if data.dtype == kind:
            zero = off
            data = (data.astype(np.int16) + 128).astype(np.uint8) if bits == 8 else (data ^ kind(1 << bits - 1)).view(f"i{bits // 8}")
    bitpix = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}[data.dtype.str[1:]] if data.size else 8
    axes = data.shape[::-1] if data.size else ()
    h = [Card("SIMPLE", True) if primary else Card("XTENSION", "IMAGE"), Card("BITPIX", bitpix), Card("NAXIS", len(axes)), *(Card(f"NAXIS{i}", n) for i, n in enumerate(axes, 1))]
    h += [Card("EXTEND", True)] if primary else [Card("PCOUNT", 0), Card("GCOUNT", 1)]
    if zero is not None:
        h += [Card("BSCALE", 1), Card("BZERO", zero)]
    header = Header(h)
    for k, v in (cards or {}).items():
        header.set(k, v)
    return header, data.astype(DTYPES[bitpix]).tobytes() if data.size else b""


def table_hdu(names: list[str], forms: list[str], rows: bytes, n_rows: int, heap: bytes = b"", cards: dict | None = None) -> tuple[Header, bytes]:
    width = sum(Tform.parse(f).width for f in forms)
    h = Header([Card("XTENSION", "BINTABLE"), Card("BITPIX", 8), Card("NAXIS", 2), Card("NAXIS1", width), Card("NAXIS2", n_rows), Card("PCOUNT", len(heap)), Card("GCOUNT", 1), Card("TFIELDS", len(names))])
    for i, (n, f) in enumerate(zip(names, forms, strict=True), 1):
        h.set(f"TTYPE{i}", n)
        h.set(f"TFORM{i}", f)
    for k, v in (cards or {}).items():
        h.set(k, v)
    return h, rows + heap


def ascii_hdu(names: list[str], forms: list[str], rows: list[tuple], cards: dict | None = None, nulls: dict[str, str] | None = None) -> tuple[Header, bytes]:
    """A text table; numbers to the right, text to the left; None needs a null text."""
    nulls, at, widths = nulls or {}, 1, []
    h = Header([Card("XTENSION", "TABLE"), Card("BITPIX", 8), Card("NAXIS", 2), Card("NAXIS1", 0), Card("NAXIS2", len(rows)), Card("PCOUNT", 0), Card("GCOUNT", 1), Card("TFIELDS", len(names))])
    for i, (n, f) in enumerate(zip(names, forms, strict=True), 1):
        w = int(re.match(r"[AIFED](\d+)", f)[1])
        for k, v in ((f"TTYPE{i}", n), (f"TBCOL{i}", at), (f"TFORM{i}", f)):
            h.set(k, v)
        if n in nulls:
            h.set(f"TNULL{i}", nulls[n])
        widths.append(w)
        at += w + 1
    h.set("NAXIS1", at - 2)
    lines = []
    for r in rows:
        parts = []
        for v, f, w, n in zip(r, forms, widths, names, strict=True):
            if v is None or isinstance(v, float) and not math.isfinite(v):
                if n not in nulls:
                    raise FormatError(f"column {n} has no null text")
                t = nulls[n].rjust(w)
            elif f[0] == "A":
                t = str(v).ljust(w)
            elif f[0] == "I":
                t = str(int(v)).rjust(w)
            else:
                dec = int(f.split(".")[1]) if "." in f else 0
                t = (f"{v:.{dec}f}" if f[0] == "F" else f"{v:.{dec}E}".replace("E", f[0])).rjust(w)
            if len(t) > w:
                raise FormatError(f"{v!r} is wider than {f}")
            parts.append(t)
        lines.append(" ".join(parts))
    for k, v in (cards or {}).items():
        h.set(k, v)
    return h, "".join(lines).encode("ascii")


def compressed_hdu(data: np.ndarray, tile: list[int] | None = None, cards: dict | None = None) -> tuple[Header, bytes]:
    """A tile-compressed image, GZIP_1, lossless; tiles are rows by default. tile: fastest axis first."""
    header, _ = image_hdu(data, cards, primary=False)
    stored = np.asarray(data)
    bitpix = int(header["BITPIX"])
    raw = image_raw(header, image_hdu(data)[1])
    axes = list(stored.shape[::-1])
    tile = tile or [axes[0], *[1] * (len(axes) - 1)]
    n = math.prod(-(-a // t) for a, t in zip(axes, tile, strict=True))
    rows, heap = b"", b""
    for k in range(n):
        origin, shape = tile_box(axes, tile, k)
        body = gzip.compress(np.ascontiguousarray(raw[tuple(slice(o, o + m) for o, m in zip(origin[::-1], shape[::-1], strict=True))]).tobytes(), 6, mtime=0)
        rows += np.array([len(body), len(heap)], dtype=">i4").tobytes()
        heap += body
    z = {"ZIMAGE": True, "ZCMPTYPE": "GZIP_1", "ZBITPIX": bitpix, "ZNAXIS": len(axes)} | {f"ZNAXIS{i}": a for i, a in enumerate(axes, 1)} | {f"ZTILE{i}": t for i, t in enumerate(tile, 1)}
    extra = {c.keyword: c.value for c in header.cards if not STRUCTURAL.fullmatch(c.keyword) or c.keyword in ("BSCALE", "BZERO", "BLANK", "EXTNAME")}
    return table_hdu(["COMPRESSED_DATA"], ["1PB"], rows, n, heap, z | extra)


def hdu_bytes(header: Header, data: bytes, checksums: bool = False) -> bytes:
    """A whole unit, padded; with DATASUM and CHECKSUM on request."""
    pad = b" " if header.get("XTENSION") == "TABLE" else b"\0"
    data = data + pad * (-len(data) % BLOCK)
    if checksums:
        total = ck.word_sum(data)
        header.set("DATASUM", str(total))
        header.set("CHECKSUM", "0" * 16)
        header.set("CHECKSUM", ck.encode(ck.word_sum(header.to_bytes(), total)))
    return header.to_bytes() + data


def verify(data: bytes) -> list[dict]:
    """For each unit whether CHECKSUM and DATASUM hold; None where there is no card."""
    out, units = [], walk(data)
    for u in units:
        end = u.data_start + -(-u.data_len // BLOCK) * BLOCK
        datasum = u.header.get("DATASUM")
        total = ck.word_sum(data[u.data_start : end])
        out.append({"hdu": u.index, "checksum_ok": ck.is_valid(data[u.start : end]) if "CHECKSUM" in u.header else None, "datasum_ok": int(str(datasum)) == total if datasum is not None and str(datasum).strip().isdigit() else None})
    return out
