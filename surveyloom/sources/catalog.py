"""``survey_catalog``: what survey files say about themselves, one table for each value of the option ``table``.

Every file is an input partition. Tables hold what is in the file; which copy of it counts, what belongs together and what
contradicts what is for the operators.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from surveyloom.functions import cells, codecs, registry
from surveyloom.functions.layout import LINE_CATEGORIES, LIVE_BIT, PAGE_MASK, SIGNATURE, SurveyFile, open_file
from surveyloom.functions.layout import payload as declared
from surveyloom.sources.survey import is_true, list_files

USER_FREE = 65536
EXTENSIONS = "Database Extension Objects"
_UNSET_REALS = struct.pack("<d", -1e32) * 8
#: What conforming files hold in a place, by the kind of record and the field (a byte offset, or a name).
EXPECTED: dict[tuple[str, str], tuple] = {
    ("header", "8"): (268566528,),
    ("header", "12"): (264,),
    ("header", "16"): (0,),
    ("header", "20"): (0,),
    ("header", "68"): (0,),
    ("channel", "100"): (1.0,),
    ("channel", "108"): (5,),
    ("users", "in use"): (1,),
    ("user", "category"): (131072,),
    ("user", "116"): (-1,),
    ("line", "type"): (0, 2, 6),
    ("line", "104"): (bytes.fromhex("aec59df414e384bcd6bf91c6176e05b5b5b89346"),),
    ("projection", "method"): tuple(registry.METHODS),
    ("projection", "slot 7"): (None,),
    ("projection", "member 1"): (bytes([1]) * 16 + bytes(28) + _UNSET_REALS,),
    ("projection", "member 2"): (bytes([2]) * 16 + bytes(64),),
    ("projection", "member 3"): (bytes([3]) * 16 + bytes(64),),
    ("extensions", "payload size"): (80,),
    ("creation", "flag"): (0,),
}

TABLES: dict[str, str] = {
    "headers": "path string, file_size long, magic_ok boolean, signature_common boolean, chans_max int, blobs_max int, lines_max int, users_max int, index_slots int, data_slots int, page_size int, comp_level int, compression_name string",
    "channels": "path string, channel_slot int, name string, var_name string, occurrence int, siblings int, type_code int, type_name string, is_string boolean, string_width int, format_code int, format_name string, array_width int, array_basetype_code int, array_basetype_name string, display_width int, display_decimals int, raw binary",
    "lines": "path string, line_slot int, name string, category_code int, category_name string, exact boolean, line_type int, occurrence int, siblings int",
    "blobs": "path string, chain_pos int, offset long, n_pages int, n_pages_dup int, blob_index int, line_slot int, channel_slot int, timestamp_raw int, class int, scale double, row_count int, gs_type_code int, is_packed boolean, packed_length int",
    "live_blobs": "path string, line_slot int, line string, channel_slot int, channel string, var_name string, offset long, n_pages int, row_count int",
    "directory": "path string, slot int, word long, n_pages int, is_live boolean, start_page long",
    "symbols": "path string, symbol_slot int, name string",
    "admin_objects": "path string, symbol_slot int, name string, tag string, payload binary",
    "setting_entries": "path string, chain_pos int, symbol string, channel_slot int, channel string, key string, value string",
    "crs_entries": "path string, chain_pos int, name string",
    "role_entries": "path string, chain_pos int, role string, value string",
    "projection_entries": "path string, chain_pos int, name string, method_code int, datum_name string, ellipsoid_name string, datum_transform_name string, units_name string, projection_name string, semi_major_axis double, eccentricity double, prime_meridian double, units_factor double, latitude_of_origin double, central_meridian double, scale_factor double, false_easting double, false_northing double, standard_parallel_1 double, standard_parallel_2 double, parameters array<double>, transform array<double>",
    "projection_texts": "path string, chain_pos int, name string, text string",
    "maker_entries": "path string, chain_pos int, channel_slot int, channel string, tool string, label string, params array<struct<k: string, v: string>>",
    "display_entries": "path string, list_no int, symbol_slot int, pos int, label string, handle long, channel string",
    "chunks": "path string, offset long, decompressed_length int, chunk_length int, marker int, kind string",
    "conformance": "path string, record string, slot int, field string, value string",
    "diagnostics": "path string, code string, line string, channel string, offset long, message string",
}

COMPRESSION = {0: "NONE", 1: "SPEED", 2: "SIZE"}


def _headers(s: SurveyFile) -> Iterator[tuple]:
    level = s.header["comp_level"]
    yield (s.size, s.is_survey, s.head[:16] == SIGNATURE, *s.header.values(), None if level is None else COMPRESSION.get(level, f"unknown({level})"))


def _channels(s: SurveyFile) -> Iterator[tuple]:
    for c in s.channels:
        yield (
            c.slot, c.name, c.var_name, c.occurrence, c.siblings, c.dtype, cells.type_name(c.dtype), c.dtype < 0, -c.dtype if c.dtype < 0 else None, c.format, cells.FORMAT_NAMES.get(c.format, f"unknown({c.format})"),
            c.width, c.basetype, cells.BASETYPE_NAMES.get(c.basetype, f"unknown({c.basetype})"), c.display_width, c.decimals, c.raw,
        )


def _lines(s: SurveyFile) -> Iterator[tuple]:
    for x in s.lines:
        yield x.slot, x.name, x.category, LINE_CATEGORIES[x.category], s.lines_exact, x.type, x.occurrence, x.siblings


def _blobs(s: SurveyFile) -> Iterator[tuple]:
    chans = s.header["chans_max"]
    for i, b in enumerate(s.blocks):
        line, channel = divmod(int(b["index"]), chans) if chans else (None, None)
        yield i, int(b["offset"]), int(b["n_pages"]), int(b["n_pages_dup"]), int(b["index"]), line, channel, int(b["timestamp"]), int(b["class"]), float(b["scale"]), int(b["row_count"]), int(b["gs_type"]), (packed := int(b["class"]) == 202), int(b["total"]) if packed else None


def _live(s: SurveyFile) -> Iterator[tuple]:
    for x in s.lines:
        for c, b in s.on_line(x):
            yield x.slot, x.name, c.slot, c.name, c.var_name, int(b["offset"]), int(b["n_pages"]), int(b["row_count"])


def _directory(s: SurveyFile) -> Iterator[tuple]:
    if s.directory is not None:
        for slot in np.flatnonzero((s.directory["word"] != 0) | (s.directory["n_pages"] != 0)).tolist():
            word = int(s.directory["word"][slot])
            yield slot, word, int(s.directory["n_pages"][slot]), bool(word & LIVE_BIT), word & PAGE_MASK


def _symbols(s: SurveyFile) -> Iterator[tuple]:
    yield from (s.symbols or {}).items()


def _tag(data: bytes) -> str:
    return data[44:48].rstrip(b"\0").decode("ascii", errors="replace")


def _admin(s: SurveyFile) -> Iterator[tuple]:
    for slot, data in sorted(s.admin_objects.items()):
        yield slot, (s.symbols or {}).get(slot), _tag(data), data


def _chain(s: SurveyFile, keep: Callable[[np.void], bool]) -> Iterator[tuple[int, np.void, bytes]]:
    with open_file(s.path) as f:
        for i, b in enumerate(s.blocks):
            if keep(b):
                yield i, b, s.block_bytes(f, b)


def _beyond_lines(s: SurveyFile) -> Iterator[tuple[int, bytes]]:
    """Blocks of line slots after the last real line."""
    last = max((x.slot for x in s.lines), default=-1)
    chans = s.header["chans_max"]
    if chans and s.header["page_size"]:
        yield from ((i, data) for i, _, data in _chain(s, lambda b: int(b["index"]) // chans > last))


def _of_channels(s: SurveyFile) -> Iterator[tuple[int, str, int, str, bytes]]:
    """(chain position, symbol, channel slot, channel, bytes) of blocks whose symbol is a channel's handle."""
    import re

    slots, base = s.header["data_slots"], (s.header["blobs_max"] or 0) + (s.header["lines_max"] or 0)
    if slots is None or s.symbols is None or not s.header["page_size"]:
        return
    names = {c.slot: c.name for c in s.channels}
    for i, b, data in _chain(s, lambda b: b["index"] >= slots and (int(b["index"]) - slots) in s.symbols):
        symbol = s.symbols[int(b["index"]) - slots]
        m = re.fullmatch(registry.CHANNEL_OBJECT, symbol)
        if m and int(m[1]) - base in names:
            yield i, symbol, int(m[1]) - base, names[int(m[1]) - base], data


def _settings(s: SurveyFile) -> Iterator[tuple]:
    for i, symbol, slot, name, data in _of_channels(s):
        yield from ((i, symbol, slot, name, k, v) for k, v in registry.settings(data) or [])


def _crs(s: SurveyFile) -> Iterator[tuple]:
    yield from ((i, name) for i, data in _beyond_lines(s) if (name := registry.crs_name(data)) is not None)


def _roles(s: SurveyFile) -> Iterator[tuple]:
    yield from ((i, role, value) for i, data in _beyond_lines(s) for role, value in registry.roles(data))


def _text_of(data: bytes) -> tuple[str, str] | None:
    kv = dict(registry.settings(data) or [])
    return (kv["_PJ_NAME"].strip('"'), kv["_PJ_PROJECTION"]) if "_PJ_NAME" in kv and "_PJ_PROJECTION" in kv else None


def _projections(s: SurveyFile) -> Iterator[tuple]:
    columns = [x.split(" ")[0] for x in TABLES["projection_entries"].split(", ")][2:]
    for i, data in _beyond_lines(s):
        if _text_of(data) is None and (p := registry.projection(data)):
            yield (i, *(p[c] for c in columns))


def _projection_texts(s: SurveyFile) -> Iterator[tuple]:
    yield from ((i, *found) for i, data in _beyond_lines(s) if (found := _text_of(data)))


def _makers(s: SurveyFile) -> Iterator[tuple]:
    for i, _, slot, name, data in _of_channels(s):
        found = registry.creation(registry.nested(declared(data)) or b"") if len(data) >= 28 else None
        if found:
            yield i, slot, name, found["tool"], found["label"], [{"k": k, "v": v} for k, v in found["settings"].items()]


def _displays(s: SurveyFile) -> Iterator[tuple]:
    base = (s.header["blobs_max"] or 0) + (s.header["lines_max"] or 0)
    names = {c.slot: c.name for c in s.channels}
    number = 0
    for slot in sorted(k for k, v in (s.symbols or {}).items() if v == registry.DISPLAY_LIST):
        rows = registry.display_list(s.admin_objects[slot]) if slot in s.admin_objects else None
        if rows is not None:
            for pos, (label, handle) in enumerate(rows):
                yield number, slot, pos, label, handle, names.get(handle - base)
            number += 1


def _chunks(s: SurveyFile) -> Iterator[tuple]:
    """Framed LZRW1 chunks anywhere in the file; it is read in pieces that overlap by a frame."""
    piece, over = 16 << 20, codecs.FRAME + 12 - 1
    with open_file(s.path) as f:
        for start in range(0, s.size, piece):
            f.seek(start)
            data = f.read(piece + over)
            for at, size, span, marker in codecs.speed_chunks(data):
                if at < piece:
                    yield start + at, size, span, marker, "cut" if marker is None else "stored" if marker == codecs.STORED else "packed" if marker == codecs.PACKED else "unknown"


def _observed(s: SurveyFile) -> Iterator[tuple[str, int, str, object]]:
    """(kind of record, its slot, field, value) of all that ``EXPECTED`` speaks of. Names, paths and texts are no part of it."""
    yield from (("header", 0, str(at), struct.unpack_from("<i", s.head, at)[0]) for kind, at in ((k, int(f)) for k, f in EXPECTED if k == "header") if at + 4 <= len(s.head))
    for c in s.channels:
        yield "channel", c.slot, "100", struct.unpack_from("<d", c.raw, 100)[0]
        yield "channel", c.slot, "108", struct.unpack_from("<h", c.raw, 108)[0]
    if s.channels_at is not None and len(s.users) == (s.header["users_max"] or 0):
        used = [(i, u) for i, u in enumerate(s.users) if u["name"].tobytes()[0] and not int(u["category"]) & USER_FREE]
        yield "users", 0, "in use", len(used)
        for i, u in used:
            yield "user", i, "category", int(u["category"])
            yield "user", i, "116", int(u["i116"])
    for x in s.lines if s.lines_exact else ():
        yield "line", x.slot, "type", x.type
        yield "line", x.slot, "104", x.block
    for slot, data in sorted(s.admin_objects.items()):
        tag = _tag(data)
        if tag == "IPJ" and (p := registry.projection(data)):
            yield "projection", slot, "method", p["method_code"]
            if p["method_code"] in registry.METHODS:
                yield "projection", slot, "slot 7", p["parameters"][7]
            yield from (("projection", slot, f"member {index}", tail) for index, _, tail in registry.members(data))
        elif tag == "EXT" and (s.symbols or {}).get(slot) == EXTENSIONS:
            yield "extensions", slot, "payload size", struct.unpack_from("<i", data, 24)[0]
        elif tag == "REG" and (found := registry.creation(registry.nested(data) or b"")):
            yield "creation", slot, "flag", found["flag"]


def _conformance(s: SurveyFile) -> Iterator[tuple]:
    """A row for each place where the file holds something else than conforming files do."""
    for kind, slot, field, value in _observed(s):
        if value not in EXPECTED.get((kind, field), (value,)):
            yield kind, slot, field, value[:64].hex() if isinstance(value, bytes) else repr(value)


def _diagnostics(s: SurveyFile, decode: bool) -> Iterator[tuple]:
    """What planning finds; with the option ``validate``, also what decoding each live cell finds."""
    _ = s.header, s.channels, s.lines, s.live
    from surveyloom.sources.survey import column_names

    column_names(s)
    if decode:
        with open_file(s.path) as f:
            for x in s.lines:
                lengths = {c.var_name: len(cells.decode(s, f, c, b, line=x.name)) for c, b in s.on_line(x)}
                for name, n in lengths.items():
                    if n < max(lengths.values()):
                        s.note("SHORT_CHANNEL", f"{n} rows, of {max(lengths.values())}", line=x.name, channel=name)
    for d in s.diagnostics:
        yield d.code, d.line, d.channel, d.offset, d.message


_SCANS: dict[str, Callable[[SurveyFile], Iterator[tuple]]] = {
    "headers": _headers, "channels": _channels, "lines": _lines, "blobs": _blobs, "live_blobs": _live, "directory": _directory, "symbols": _symbols, "admin_objects": _admin, "setting_entries": _settings, "crs_entries": _crs,
    "role_entries": _roles, "projection_entries": _projections, "projection_texts": _projection_texts, "maker_entries": _makers, "display_entries": _displays, "chunks": _chunks, "conformance": _conformance,
}


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CatalogReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, table: str):
        self.names, self.options, self.table = [x.name for x in schema.fields], dict(options), table
        self.all = [x.split(" ")[0] for x in _columns(TABLES[table])]
        self.files = list_files(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in self.files] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if not partition.path:
            return
        survey = SurveyFile(partition.path, is_true(self.options, "includeunlisted"))
        rows = _diagnostics(survey, is_true(self.options, "validate")) if self.table == "diagnostics" else _SCANS[self.table](survey)
        most = int(self.options.get("limit", -1))
        at = [self.all.index(n) for n in self.names]
        for i, row in enumerate(rows):
            if i == most:
                return
            whole = (partition.path, *row)
            yield tuple(whole[k] for k in at)


def _columns(ddl: str) -> list[str]:
    """The columns of a DDL string; commas within brackets don't part them."""
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


class PushingCatalogReader(CatalogReader):
    def pushFilters(self, filters):  # noqa: N802  the API's name
        for x in filters:
            values = {x.value} if isinstance(x, EqualTo) else set(x.value) if isinstance(x, In) else None
            if values is not None and x.attribute == ("path",):
                self.files = [p for p in self.files if p in values]
            else:
                yield x


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "survey_catalog"

    @property
    def table(self) -> str:
        table = self.options.get("table", "headers")
        if table not in TABLES:
            raise ValueError(f"no catalog table {table!r}; there are {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self.table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingCatalogReader if is_true(self.options, "pushdown") else CatalogReader)(schema, self.options, self.table)


