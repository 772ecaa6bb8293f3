"""One-call access to files: read and edit headers and data, write, append, patch, compare, verify."""

from __future__ import annotations

import os

import numpy as np

from astrolane.sources import container as ct


class File:
    """A file's units in memory; edits are written by ``flush`` or ``writeto``."""

    def __init__(self, path: str | None = None, data: bytes | None = None, mode: str = "readonly", lenient: bool = True):
        self.path, self.mode = path, mode
        self.data = data if data is not None else ct.read_file(path) if path else b""
        self.units: list[tuple[ct.Header, bytes]] = [(u.header, u.raw) for u in ct.walk(self.data, lenient)] if self.data else []
        self.dirty = False

    def __enter__(self) -> File:
        return self

    def __exit__(self, *exc) -> None:
        if exc == (None, None, None):
            self.close()

    def __len__(self) -> int:
        return len(self.units)

    def hdu(self, key: int | str | tuple[str, int]) -> ct.Hdu:
        """By number, name, or name and version."""
        made = [ct.Hdu(i, h, 0, 0, len(raw), ct.kind_of(h, i), raw) for i, (h, raw) in enumerate(self.units)]
        if isinstance(key, int):
            return made[key]
        name, version = key if isinstance(key, tuple) else (key, 1)
        for u in made:
            if u.name == name and u.version == version:
                return u
        raise KeyError(key)

    __getitem__ = hdu

    def _writable(self) -> None:
        if self.mode != "update":
            raise ct.FormatError("the file is open for reading")
        self.dirty = True

    def append(self, unit: tuple[ct.Header, bytes]) -> None:
        self._writable()
        self.units.append(unit)

    def insert(self, at: int, unit: tuple[ct.Header, bytes]) -> None:
        self._writable()
        self.units.insert(at, unit)

    def __delitem__(self, at: int) -> None:
        self._writable()
        del self.units[at]

    def __setitem__(self, at: int, unit: tuple[ct.Header, bytes]) -> None:
        self._writable()
        self.units[at] = unit

    def patch(self, key: int, origin: tuple[int, ...], values: np.ndarray) -> None:
        """Pixels of a box, fastest axis first, in stored values; images without scaling only."""
        self._writable()
        u = self.hdu(key)
        if float(u.header.get("BSCALE", 1)) != 1 or float(u.header.get("BZERO", 0)) != 0:
            raise ct.FormatError("a scaled image is not patched")
        a = ct.image_raw(u.header, u.raw).copy()
        values = np.asarray(values)
        box = tuple(slice(o, o + n) for o, n in zip(origin[::-1], values.shape, strict=True))
        if any(s.stop > n or s.start < 0 for s, n in zip(box, a.shape, strict=True)):
            raise ct.FormatError("the box leaves the image")
        a[box] = values
        self.units[u.index] = (u.header, a.tobytes())

    def to_bytes(self, checksums: bool = False) -> bytes:
        units = list(self.units)
        if units and "XTENSION" in units[0][0]:
            units.insert(0, ct.image_hdu(None))
        return b"".join(ct.hdu_bytes(h, raw, checksums) for h, raw in units)

    def writeto(self, path: str, overwrite: bool = False, checksums: bool = False) -> None:
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        with open(f"{path}.tmp", "wb") as f:
            f.write(self.to_bytes(checksums))
        os.replace(f"{path}.tmp", path)

    def flush(self) -> None:
        if self.dirty:
            self.writeto(self.path, overwrite=True)
            self.dirty = False

    def close(self) -> None:
        if self.mode == "update":
            self.flush()


def open_file(path: str, mode: str = "readonly", lenient: bool = True) -> File:
    if mode not in ("readonly", "update"):
        raise ValueError(f"mode {mode!r}")
    return File(path, mode=mode, lenient=lenient)


def info(path: str) -> list[tuple]:
    """Number, name, version, kind and axes of each unit."""
    return [(u.index, u.name, u.version, u.kind, u.axes) for u in ct.walk(ct.read_file(path), with_data=False)]


def getheader(path: str, ext: int | str = 0) -> ct.Header:
    return File(path).hdu(ext).header


def getval(path: str, key: str, ext: int | str = 0):
    return getheader(path, ext)[key]


def getdata(path: str, ext: int | str | None = None):
    """Pixels of an image, or rows of a table; without ext, of the first unit that has data."""
    f = File(path)
    u = f.hdu(ext) if ext is not None else next((x for x in map(f.hdu, range(len(f))) if x.data_len), f.hdu(0))
    if u.kind == "image":
        return ct.physical(u.header, ct.image_raw(u.header, u.raw)) if u.data_len else None
    if u.kind == "compressed":
        return ct.physical(ct.image_header_of(u.header), ct.decompress(u))
    if u.kind == "bintable":
        return [dict(zip([c.name for c in ct.columns(u.header)], r, strict=True)) for r in ct.bintable_rows(u)]
    if u.kind == "ascii":
        return [dict(zip([c[0] for c in ct.ascii_columns(u.header)], r, strict=True)) for r in ct.ascii_rows(u)]
    return list(ct.group_rows(u)) if u.kind == "groups" else u.raw


def setval(path: str, key: str, value, ext: int = 0, comment: str | None = None) -> None:
    with File(path, mode="update") as f:
        f.hdu(ext).header.set(key, value, comment)
        f.dirty = True


def delval(path: str, key: str, ext: int = 0) -> None:
    with File(path, mode="update") as f:
        if not f.hdu(ext).header.remove(key):
            raise KeyError(key)
        f.dirty = True


def write(path: str, units: list[tuple[ct.Header, bytes]], overwrite: bool = False, checksums: bool = False) -> None:
    f = File()
    f.units = list(units)
    f.writeto(path, overwrite, checksums)


def append(path: str, unit: tuple[ct.Header, bytes]) -> None:
    """Adds a unit behind the last one; what is there is not written again."""
    with open(path, "r+b") as f:
        data = f.read()
        last = ct.walk(data)[-1]
        f.seek(last.data_start + -(-last.data_len // ct.BLOCK) * ct.BLOCK)
        f.truncate()
        f.write(ct.hdu_bytes(*unit))


def funpack(path: str, out: str, overwrite: bool = False, checksums: bool = True) -> None:
    """A copy with compressed images as plain ones."""
    f = File(path)
    units = []
    for i in range(len(f)):
        u = f.hdu(i)
        if u.kind == "compressed":
            h = ct.image_header_of(u.header)
            units.append((h, ct.decompress(u).astype(ct.DTYPES[int(h["BITPIX"])]).tobytes()))
        else:
            units.append((u.header, u.raw))
    write(out, units, overwrite, checksums)


def verify_checksums(path: str) -> list[dict]:
    return ct.verify(ct.read_file(path))


def add_checksums(path: str) -> None:
    File(path).writeto(path, overwrite=True, checksums=True)


# what the command line offers, as functions

def cli_header(path: str, contains: str = "") -> list[str]:
    return [x for u in ct.walk(ct.read_file(path), with_data=False) for c in u.header.cards if contains.upper() in c.keyword for x in ct.render(c)]


def stats(path: str) -> list[dict]:
    """Count, least, greatest, mean and population deviation of the finite pixels of each image."""
    out = []
    f = File(path)
    for i in range(len(f)):
        u = f.hdu(i)
        if u.kind not in ("image", "compressed") or not u.data_len:
            continue
        v = np.asarray(getdata(path, i), dtype=float).ravel()
        v = v[np.isfinite(v)]
        nan = float("nan")
        out.append({"hdu": i, "n": len(v), "min": float(v.min()) if len(v) else nan, "max": float(v.max()) if len(v) else nan, "mean": float(v.mean()) if len(v) else nan, "std": float(v.std()) if len(v) else nan})
    return out


image, compressed_image, bintable, ascii_table = ct.image_hdu, ct.compressed_hdu, ct.table_hdu, ct.ascii_hdu
