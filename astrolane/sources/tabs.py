"""Lookup arrays of -TAB axes, from the binary table that a header names."""

from __future__ import annotations

import numpy as np

from astrolane.functions.tabular import TabGrid
from astrolane.operators.wcs import Tab
from astrolane.sources import container as ct


def resolve_tab(path: str, header: dict, alt: str = " ") -> tuple[dict[int, Tab], dict[tuple[int, ...], TabGrid]]:
    """Arrays of axes that are looked up alone, by axis from 0, and of axes that share an array, by their axes in the array's order.

    PSi_0 to PSi_2 name the table, its array and its index vector, PVi_1 to PVi_3
    version, level and place in the array.  The table has one row.
    """
    a = alt.strip()
    n = int(header.get("WCSAXES" + a, header.get("NAXIS", 0)) or 0)
    groups: dict[tuple, list[tuple[int, int, str | None]]] = {}
    for i in range(1, n + 1):
        if str(header.get(f"CTYPE{i}{a}", "")).strip().endswith("-TAB"):
            number = lambda m, i=i: int(header.get(f"PV{i}_{m}{a}", 1))
            text = lambda m, i=i: str(header.get(f"PS{i}_{m}{a}", "") or "").strip()
            groups.setdefault((text(0), number(1), number(2), text(1)), []).append((number(3), i - 1, text(2) or None))
    lines, grids = {}, {}
    units = ct.walk(ct.read_file(path)) if groups else []
    for (name, version, level, array), axes in groups.items():
        found = [u for u in units if u.name == name and u.version == version]
        if not found or found[0].kind != "bintable" or int(found[0].header.get("EXTLEVEL", 1)) != level:
            raise ct.FormatError(f"no table {name!r}, version {version}, level {level}")
        if int(found[0].header["NAXIS2"]) != 1:
            raise ct.FormatError(f"table {name!r} must have one row")
        held = {c.name: v for c, v in zip(ct.columns(found[0].header), next(ct.bintable_rows(found[0])), strict=True)}
        axes.sort()
        for want in (array, *(x for *_, x in axes if x)):
            if want not in held:
                raise ct.FormatError(f"table {name!r} has no column {want!r}")
        coords = np.asarray(held[array], dtype=float)
        if coords.ndim < 2:
            coords = coords.reshape(-1, 1)
        if [m for m, *_ in axes] != list(range(1, coords.ndim)):
            raise ct.FormatError(f"array {array!r} has {coords.ndim - 1} axes, the header names {[m for m, *_ in axes]}")
        index = [np.ravel(np.asarray(held[x], dtype=float)) if x else None for *_, x in axes]
        if len(axes) == 1:
            values = coords[:, 0]
            lines[axes[0][1]] = Tab(tuple(map(float, index[0] if index[0] is not None else range(1, len(values) + 1))), tuple(map(float, values)))
        else:
            grids[tuple(i for _, i, _ in axes)] = TabGrid(coords, tuple(index))
    return lines, grids
