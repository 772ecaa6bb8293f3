"""Stored numbers to physical ones: image scaling, table scaling, unsigned conventions, text reals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from astrolane.stages import NAN, num


def physical(raw: str, bscale: float = 1.0, bzero: float = 0.0, blank: int | None = None) -> str:
    """BZERO + BSCALE * stored; a stored BLANK is NaN."""
    v = f"({num(bzero)} + {num(bscale)} * cast({raw} as double))"
    return v if blank is None else f"case when ({raw}) = {blank} then {NAN} else {v} end"


def physical_f32(raw: str, bscale: float = 1.0, bzero: float = 0.0) -> str:
    """The same, rounded to single precision."""
    return f"cast({physical(raw, bscale, bzero)} as float)"


def unsigned(raw: str, bits: int) -> str:
    """Signed stored values under the unsigned convention (BZERO = 2^(bits-1)), in exact integers."""
    kind = "bigint" if bits <= 32 else "decimal(20,0)"
    return f"(cast({raw} as {kind}) + cast('{2 ** (bits - 1)}' as {kind}))"


def signed_byte(raw: str) -> str:
    """Stored 0 to 255 as -128 to 127 (BZERO = -128)."""
    return f"(cast({raw} as bigint) - 128)"


def tnull(raw: str, null: int) -> str:
    """Null where the stored value is TNULL."""
    return f"case when ({raw}) = {null} then null else ({raw}) end"


def tscal(raw: str, scale: float, zero: float, null: int | None = None) -> str:
    """TZERO + TSCAL * stored; a stored TNULL of a scaled column is NaN."""
    return physical(raw, scale, zero, null)


@dataclass(frozen=True)
class Tform:
    """A binary table format: repeat, code, and for descriptors the element code and length limit."""

    repeat: int
    code: str
    inner: str = ""
    most: int | None = None

    BYTES = {"L": 1, "X": 0, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}

    @classmethod
    def parse(cls, text: str) -> Tform:
        m = re.match(r"\s*(\d*)([LXBIJKAEDCMPQ])\s*([LXBIJKAEDCM]?)(?:\((\d+)\))?", text)
        if not m:
            raise ValueError(f"TFORM {text!r}")
        repeat = int(m[1]) if m[1] else 1
        if m[2] in "PQ" and repeat > 1:
            raise ValueError("a descriptor's repeat is 0 or 1")
        return cls(repeat, m[2], m[3] if m[2] in "PQ" else "", int(m[4]) if m[4] else None)

    @property
    def width(self) -> int:
        return (self.repeat + 7) // 8 if self.code == "X" else self.repeat * self.BYTES[self.code]


def fortran_real(text: str, decimals: int = 0) -> str:
    """A real of a text table: D exponents, exponents without a letter, an implied decimal point, blank as 0; null where it is no number."""
    t = f"upper(translate(trim({text}), 'Dd', 'Ee'))"
    mant = f"regexp_extract({t}, '^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+))E?([+-]?[0-9]+)?$', 1)"
    power = f"coalesce(cast(nullif(regexp_extract({t}, '^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+))E?([+-]?[0-9]+)?$', 3), '') as double), 0e0)"
    shift = f"case when {mant} like '%.%' then 0e0 else {num(float(decimals))} end"
    return f"case when {t} = '' then 0e0 when {mant} = '' then null else cast({mant} as double) * pow(10e0, {power} - {shift}) end"
