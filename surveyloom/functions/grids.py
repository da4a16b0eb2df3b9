"""Grid files: header, block table, blocks."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from surveyloom.functions.layout import Diagnostic, open_file

# Fixed values of the format.
HEADER = 512
SIZES = (1, 2, 4, 8, 1025, 1026, 1028, 1032)
PACKED = 1024
BLOCK_FRAME = 16
STORED = {(1, 0): "<u1", (2, 0): "<u2", (4, 0): "<u4", (4, 1): "<i4", (4, 2): "<f4"}
DUMMY = {"<i1": -127, "<u1": 255, "<i2": -32767, "<u2": 65535, "<i4": -2147483647, "<u4": 4294967295, "<f4": -1e32, "<f8": -1e32}


@dataclass
class Grid:
    path: str
    element: int
    packed: bool
    sign: int
    shape_e: int
    shape_v: int
    ordering: int
    spacing_e: float
    spacing_v: float
    x_origin: float
    y_origin: float
    rotation: float
    base_value: float
    data_factor: float
    dtype: str
    #: (first element, elements, file offset, bytes) of what can be read on its own
    parts: list[tuple[int, int, int, int]]
    diagnostics: list[Diagnostic]

    @property
    def dummy(self) -> float | int:
        return DUMMY[self.dtype]


def stored_type(element: int, sign: int) -> str:
    if element not in (1, 2, 4, 8):
        raise NotImplementedError(f"elements of {element} bytes")
    if element == 8:
        return "<f8"
    if element < 4:
        return STORED.get((element, sign), f"<i{element}")
    if (4, sign) not in STORED:
        raise NotImplementedError(f"sign flag {sign} for elements of 4 bytes")
    return STORED[4, sign]


def plan(path: str, part_bytes: int = 32 << 20) -> Grid:
    """The header, and what to read: whole blocks of a packed grid, runs of whole vectors of a plain one."""
    with open_file(path) as f:
        size = f.size()
        head = f.read(HEADER)
        if len(head) < HEADER:
            raise ValueError(f"{path}: {len(head)} bytes hold no grid header of {HEADER}")
        es, sign, ne, nv, kx = struct.unpack_from("<5i", head)
        numbers = struct.unpack_from("<7d", head, 20)
        if es not in SIZES:
            raise NotImplementedError(f"{path}: element size field {es}")
        element = es % PACKED
        dtype, notes, parts = stored_type(element, sign), [], []
        total = max(0, ne) * max(0, nv)
        if es > PACKED:
            f.seek(HEADER)
            table = f.read(16)
            n, per = struct.unpack_from("<2i", table, 8) if len(table) == 16 else (0, 0)
            raw = f.read(12 * n) if n > 0 else b""
            if len(table) < 16 or n < 0 or len(raw) < 12 * n:
                notes.append(Diagnostic("GRID_TABLE", "the block table is cut off"))
            else:
                offsets, sizes = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i4", n, 8 * n)
                for i, (at, span) in enumerate(zip(offsets.tolist(), sizes.tolist(), strict=True)):
                    first = i * per * ne
                    parts.append((first, max(0, min(per * ne, total - first)), at + BLOCK_FRAME, span - BLOCK_FRAME))
        else:
            rows = max(1, part_bytes // max(1, element * ne))
            there = (size - HEADER) // element
            for v in range(0, nv, rows):
                first, n = v * ne, min(rows, nv - v) * ne
                n = min(n, max(0, there - first))
                if n:
                    parts.append((first, n, HEADER + first * element, n * element))
            if there != total:
                notes.append(Diagnostic("GRID_COUNT", f"{there} elements, of {total}"))
    return Grid(path, element, es > PACKED, sign, ne, nv, kx, *numbers, dtype, parts, notes)


def read_part(grid: Grid, part: tuple[int, int, int, int], f) -> np.ndarray | None:
    """The elements of a part; None where a packed block can't be decoded."""
    _, n, at, size = part
    if size < 0:
        return None
    f.seek(at)
    raw = f.read(size)
    if grid.packed:
        if len(raw) < size:
            return None
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            return None
    width = np.dtype(grid.dtype).itemsize
    return np.frombuffer(raw[: len(raw) // width * width], grid.dtype)
