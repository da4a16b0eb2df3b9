"""Writes small survey and grid files from arrays, for queries over known data and for tests. Not a product feature: surveys are read only."""

from __future__ import annotations

import io
import shutil
import struct
import tempfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

PAGE = 1024
CHUNK = 16368
# Fixed values of the format, stated once more: the reader's are not used here, so that a wrong one shows.
SIGNATURE = bytes.fromhex("21434244000000000000021008010000")
BLOCK_MAGIC = bytes.fromhex("cccc00ff")
CHUNK_MAGIC = bytes.fromhex("0f0efffe12345678")
SIZE, PACKED, STORED = 2, -186263865, -253635901
RECORD, DIRECTORY, LIVE_BIT = 128, 280, 2147483648
ENTRY = np.dtype([("word", "<u4"), ("n_pages", "<u2")])
HEADER_WORDS = {"chans_max": 24, "blobs_max": 28, "lines_max": 36, "users_max": 40, "index_slots": 44, "data_slots": 48, "page_size": 100, "comp_level": 120}
START_PAGE = 108
LINE_BLOCK = bytes.fromhex("aec59df414e384bcd6bf91c6176e05b5b5b89346")
NUMBERS = {0: "<i1", 1: "<u2", 2: "<i2", 3: "<i4", 4: "<f4", 5: "<f8", 6: "<u1", 7: "<u4", 8: "<i8", 9: "<u8"}
OBJECT_FRAME, MEMBER_FRAME, TAG_BLOCK = bytes.fromhex("ff00f00f"), bytes.fromhex("ff00e11e"), bytes.fromhex("001accff")
UNSET = -1e32
PROJECTION_TEXTS = {"datum_name": 180, "ellipsoid_name": 244, "datum_transform_name": 332, "units_name": 452, "projection_name": 524}
PROJECTION_REALS = {"semi_major_axis": 308, "eccentricity": 316, "prime_meridian": 324, "units_factor": 516}


@dataclass
class Survey:
    """Channels are (name, type code, width); cells are arrays by (line, channel), of rows or of flat elements."""

    channels: list[tuple[str, int, int]]
    lines: list[tuple[str, int]]
    cells: dict[tuple[int, int], object]
    comp_level: int = 0
    #: how SPEED chunks are made: literal, copies, stored; "bare" blocks are plain in a file that says it is packed
    speed: str = "literal"
    directory: bool = True
    stale: dict[tuple[int, int], object] = field(default_factory=dict)
    stale_after: bool = False
    unlisted: set[tuple[int, int]] = field(default_factory=set)
    #: cell to what is wrong with its entry: page, index, pages, flag
    invalid: dict[tuple[int, int], str] = field(default_factory=dict)
    #: (symbol, block bytes from +24 on; None: a freed symbol's)
    objects: list[tuple[str, bytes]] = field(default_factory=list)
    junk_pages: int = 0
    #: "exact", or "shifted": the table isn't where the header says, and its first slot is no line
    line_table: str = "exact"
    users: int = 1
    page: int = PAGE
    rows_said: dict[tuple[int, int], int] = field(default_factory=dict)
    #: in place of ``cells`` and ``stale``: both of some lines at a time, in order, so that they are never held together
    feed: Callable[[], Iterator[tuple[dict, dict]]] | None = None


def to_bytes(dtype: int, values) -> bytes:
    if dtype < 0:
        texts = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.array(values, pa.string())).dictionary_encode()
        each = np.array([v.encode("latin-1")[:-dtype] for v in texts.dictionary.to_pylist()], f"S{-dtype}")
        return each[texts.indices.to_numpy()].tobytes()
    return np.ascontiguousarray(values).astype(NUMBERS[dtype]).tobytes()


def lzrw1(data: bytes, back: int | None) -> bytes:
    """A stream of literals, or with copies of what stands ``back`` bytes before where that is the same."""
    if not back:
        whole = len(data) // 16
        groups = np.zeros((whole, 18), np.uint8)
        groups[:, 2:] = np.frombuffer(data, np.uint8, 16 * whole).reshape(whole, 16)
        return groups.tobytes() + (b"\0\0" + data[16 * whole :] if len(data) % 16 else b"")
    out, at = bytearray(), 0
    while at < len(data):
        control, body = 0, bytearray()
        for bit in range(16):
            if at >= len(data):
                break
            n = 0
            if at >= back:
                while n < 16 and at + n < len(data) and data[at + n] == data[at + n - back]:
                    n += 1
            if n >= 3:
                control |= 1 << bit
                body += bytes([(back >> 4) & 0xF0 | n - 1, back & 0xFF])
                at += n
            else:
                body.append(data[at])
                at += 1
        out += struct.pack("<H", control) + body
    return bytes(out)


def framed(data: bytes, level: int, speed: str, width: int) -> bytes:
    head = CHUNK_MAGIC + struct.pack("<ii", level, 0)
    if level == SIZE:
        return head + zlib.compress(data)
    out = bytearray(head)
    for i in range(0, max(len(data), 1), CHUNK):
        piece = data[i : i + CHUNK]
        if speed == "stored":
            out += struct.pack("<iii", len(piece), len(piece) + 12, STORED) + piece
        else:
            packed = lzrw1(piece, width if speed == "copies" else None)
            out += struct.pack("<iii", len(piece), len(packed) + 12, PACKED) + packed
    return bytes(out)


def block(index: int, raw: bytes, dtype: int, rows: int, level: int, speed: str, page: int, width: int) -> bytes:
    if level and speed != "bare" and raw:
        inner = framed(raw, level, speed, width)
        body = struct.pack("<ii", len(raw), len(inner)) + struct.pack("<d", 1.0) + struct.pack("<d", 1.0) + struct.pack("<ii", rows, dtype) + inner
        kind = 202
    else:
        body = struct.pack("<iid", 0, 0, 1.0) + struct.pack("<ii", rows, dtype) + raw
        kind = 200
    pages = -(-(24 + len(body)) // page)
    head = BLOCK_MAGIC + struct.pack("<iiiii", pages, pages, index, 0, kind)
    return (head + body).ljust(pages * page, b"\0")


def record(name: str, fields: dict[int, bytes]) -> bytes:
    out = bytearray(name.encode("latin-1")[:63].ljust(RECORD, b"\0"))
    for at, raw in fields.items():
        out[at : at + len(raw)] = raw
    return bytes(out)


def encode(s: Survey) -> bytes:
    out = io.BytesIO()
    write(s, out)
    return out.getvalue()


def write(s: Survey, out) -> None:
    """The file's bytes to ``out``. Blocks wait in a file of their own until the directory, which comes before them, is known."""
    with tempfile.TemporaryFile() as blocks:
        out.write(_front(s, blocks))
        blocks.seek(0)
        shutil.copyfileobj(blocks, out, 1 << 20)


def _front(s: Survey, blocks) -> bytes:
    """What stands before the blocks, which go to ``blocks``."""
    n_chans, shift = len(s.channels) + 1, s.line_table == "shifted"
    n_lines, n_objects = len(s.lines) + 1 + shift, max(1, len(s.objects)) + 2
    data_slots = n_lines * n_chans
    index_slots = data_slots + n_objects
    i4 = lambda *v: struct.pack(f"<{len(v)}i", *v)
    symbols = b"".join(record(name, {76: i4(0)}) for name, _ in s.objects)
    symbols += record("", {76: i4(65536)}) * (n_objects - len(s.objects))
    lines = b"".join(record(name, {76: i4(category), 96: i4(0), 104: LINE_BLOCK}) for name, category in s.lines)
    lines = record("L0", {76: i4(65536)}) * shift + lines + record("", {76: i4(65536)})
    channels = b"".join(
        record(name, {76: struct.pack("<hh", dtype, 0), 84: struct.pack("<hh", 0, 10), 88: i4(3), 100: struct.pack("<d", 1.0), 108: struct.pack("<hh", 5, width)}) for name, dtype, width in s.channels
    ) + record("", {})
    users = b"".join(record("SUPER" if not u else f"user{u}", {76: i4(131072), 116: i4(-1)}) for u in range(s.users))
    head_size = DIRECTORY + ENTRY.itemsize * index_slots
    tables = symbols + lines + (b"\0" * 64 if shift else b"") + channels + users
    start_page = -(-(head_size + len(tables)) // s.page)
    entries, page_at = {}, s.junk_pages
    put = lambda raw: blocks.write(raw) // s.page

    def cell(key: tuple[int, int], values) -> bytes:
        _, dtype, width = s.channels[key[1]]
        raw = to_bytes(dtype, values)
        size = -dtype if dtype < 0 else np.dtype(NUMBERS[dtype]).itemsize
        return block((key[0] + shift) * n_chans + key[1], raw, dtype, s.rows_said.get(key, len(raw) // size), s.comp_level, s.speed, s.page, size)

    for cells, stale in s.feed() if s.feed else [(s.cells, s.stale)]:
        for key, values in sorted(cells.items()):
            copies = [(False, stale[key])] if key in stale else []
            copies.insert(0 if s.stale_after else len(copies), (True, values))
            for current, v in copies:
                n = put(cell(key, v))
                if current:
                    slot = (key[0] + shift) * n_chans + key[1]
                    word = LIVE_BIT | page_at
                    wrong = s.invalid.get(key)
                    entries[slot] = (word + 1 if wrong == "page" else word & ~LIVE_BIT if wrong == "flag" else word, n + 1 if wrong == "pages" else n)
                    if wrong == "index":
                        entries[slot] = (LIVE_BIT | s.junk_pages, n) if page_at != s.junk_pages else (word + 7, n)
                    if key in s.unlisted:
                        entries.pop(slot)
                page_at += n
    for i, (_, body) in enumerate(s.objects):
        pages = -(-(24 + len(body)) // s.page)
        raw = BLOCK_MAGIC + i4(pages, pages, data_slots + i, 0, 100) + body
        put(raw.ljust(pages * s.page, b"\0"))
        entries[data_slots + i] = (LIVE_BIT | page_at, pages)
        page_at += pages
    directory = np.zeros(index_slots, ENTRY)
    if s.directory:
        for slot, e in entries.items():
            directory[slot] = e
    head = bytearray(256)
    head[:16] = SIGNATURE
    for name, value in {"chans_max": n_chans, "blobs_max": n_objects, "lines_max": n_lines, "users_max": s.users, "index_slots": index_slots, "data_slots": data_slots, "page_size": s.page, "comp_level": s.comp_level}.items():
        struct.pack_into("<i", head, HEADER_WORDS[name], value)
    struct.pack_into("<i", head, START_PAGE, start_page)
    front = bytes(head) + b"\0" * 24 + directory.tobytes() + tables
    return front.ljust(start_page * s.page, b"\0") + b"\xaa" * (s.junk_pages * s.page)


def handle(s: Survey, channel: int) -> str:
    """The symbol of an object that belongs to a channel."""
    return f"__{max(1, len(s.objects)) + 2 + len(s.lines) + 1 + (s.line_table == 'shifted') + channel}"


def reg(entries: list[tuple[str, str]], nested: bytes | None = None, spare: int = 0) -> bytes:
    """A key/value object's bytes from +24 on."""
    body = b"".join(f"{k}\0{v}\0".encode().ljust(256, b"\0") for k, v in entries)
    n = len(entries) - spare
    tail = struct.pack("<i", 0 if nested is None else 1) + (nested or b"\0\0\0\0")
    inner = b"\0" * 16 + b"REG\0" + b"\0" * (124 - 48) + struct.pack("<i", n) + body + tail
    return struct.pack("<i", len(inner)) + inner


def maker(tool: str, label: str, params: list[tuple[str, str]], mark: bool = True) -> bytes:
    name, text = tool.encode() + b"\0", label.encode() + b"\0"
    lines = (b"\xef\xbb\xbf" if mark else b"") + "".join(f'{k}="{v}"\r\n' for k, v in params).encode() + b"\x1a"
    head = OBJECT_FRAME + b"\0" * 12 + b"MAKER".ljust(16, b"\0") + MEMBER_FRAME + b"\0" * 28 + TAG_BLOCK + b"MAKE" + b"\0" * 4
    return head + struct.pack("<i", len(name)) + name + b"\0\0" + struct.pack("<i", len(text)) + text + lines


def projection(name: str, method: int, slots: list[float | None], datum="WGS 84", ellipsoid="WGS 84", transform: list[float] | None = None, units="m", texts: dict[str, str] | None = None) -> bytes:
    out = bytearray(652 + 64)
    out[44:48] = b"IPJ\0"
    out[96:104] = b" JPI" + b"\x01\x00\x00\x00"
    out[104 : 104 + len(name) + 1] = name.encode() + b"\0"
    struct.pack_into("<i", out, 168, method)
    for k, v in ({"datum_name": datum, "ellipsoid_name": ellipsoid, "datum_transform_name": "[WGS 84] to WGS 84 - World", "units_name": units, "projection_name": name} | (texts or {})).items():
        out[PROJECTION_TEXTS[k] : PROJECTION_TEXTS[k] + len(v)] = v.encode()
    for k, v in {"semi_major_axis": 6378137.0, "eccentricity": 0.081819190842621, "prime_meridian": 0.0, "units_factor": 1.0}.items():
        struct.pack_into("<d", out, PROJECTION_REALS[k], v)
    struct.pack_into("<7d", out, 396, *(transform or [UNSET] + [0.0] * 5 + [1.0]))
    for i, v in enumerate(slots):
        struct.pack_into("<d", out, 588 + 8 * i, UNSET if v is None else v)
    struct.pack_into("<i", out, 24, len(out) - 28)
    return bytes(out[24:])


def display_list(rows: list[tuple[str, int]], width: int = 82) -> bytes:
    body = b"".join(f"{label}\0{number}\0".encode().ljust(width, b"\0") for label, number in rows)
    inner = b"\0" * 32 + TAG_BLOCK + b"VV  " + struct.pack("<iii", 0, -width, len(rows)) + body
    return struct.pack("<i", len(inner)) + inner


def grid(values: np.ndarray, packed: bool = False, per_block: int = 2, sign: int = 2, origin: tuple[float, float] = (0.0, 0.0)) -> bytes:
    """Rows of ``values`` are vectors."""
    nv, ne = values.shape
    size = values.dtype.itemsize
    head = struct.pack("<5i5d2d", size + (1024 if packed else 0), sign, ne, nv, 1, 1.0, 1.0, *origin, 0.0, 0.0, 1.0).ljust(512, b"\0")
    if not packed:
        return head + values.tobytes()
    parts = [zlib.compress(values[i : i + per_block].tobytes()) for i in range(0, nv, per_block)]
    table_size = 16 + 12 * len(parts)
    offsets, at = [], 512 + table_size
    for p in parts:
        offsets.append(at)
        at += 16 + len(p)
    table = b"\0" * 8 + struct.pack("<2i", len(parts), per_block) + struct.pack(f"<{len(parts)}q", *offsets) + struct.pack(f"<{len(parts)}i", *[len(p) + 16 for p in parts])
    return head + table + b"".join(b"\0" * 16 + p for p in parts)
