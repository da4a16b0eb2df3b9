"""Values of one cell (a line's channel) as an Arrow array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from surveyloom.functions import codecs
from surveyloom.functions.layout import BLOCK, PACKED_HEADER, Channel, SurveyFile

# Fixed values of the format, by type code: stored type, what marks missing data, name.
STORED = {0: "<i1", 1: "<u2", 2: "<i2", 3: "<i4", 4: "<f4", 5: "<f8", 6: "<u1", 7: "<u4", 8: "<i8", 9: "<u8"}
DUMMY = {0: -127, 1: 65535, 2: -32767, 3: -2147483647, 4: -1e32, 5: -1e32, 6: 255, 7: 4294967295, 8: -(2**63), 9: 2**64 - 1}
TYPE_NAMES = {0: "GS_BYTE", 1: "GS_USHORT", 2: "GS_SHORT", 3: "GS_LONG", 4: "GS_FLOAT", 5: "GS_DOUBLE", 6: "GS_UBYTE", 7: "GS_ULONG", 8: "GS_LONG64", 9: "GS_ULONG64", 10: "GS_FLOAT3D", 11: "GS_DOUBLE3D", 12: "GS_FLOAT2D", 13: "GS_DOUBLE2D"}
FORMAT_NAMES = {0: "NORMAL", 1: "EXP", 2: "TIME", 3: "DATE", 4: "GEOGR", 5: "SIGDIG", 6: "HEX"}
BASETYPE_NAMES = {0: "NONE", 1: "TIME_WINDOWS", 2: "TIMES", 3: "FREQUENCIES", 4: "ELEVATIONS", 5: "DEPTHS", 6: "VELOCITIES", 7: "DISCRETE_TIME_WINDOWS", 8: "ENERGIES"}

#: Spark has no unsigned types: each code goes to the next wider signed one.
_WIDE = {0: pa.int8(), 1: pa.int32(), 2: pa.int16(), 3: pa.int32(), 4: pa.float32(), 5: pa.float64(), 6: pa.int16(), 7: pa.int64(), 8: pa.int64(), 9: pa.decimal128(20, 0)}
_SPARK = {0: "byte", 1: "int", 2: "short", 3: "int", 4: "float", 5: "double", 6: "short", 7: "long", 8: "long", 9: "decimal(20,0)"}


def type_name(dtype: int) -> str:
    return f"string[{-dtype}]" if dtype < 0 else TYPE_NAMES.get(dtype, f"unknown({dtype})")


def known(dtype: int) -> bool:
    return dtype < 0 or dtype in STORED


def arrow_type(dtype: int, width: int = 1) -> pa.DataType:
    one = pa.string() if dtype < 0 else _WIDE.get(dtype, pa.float64())
    return pa.list_(one) if width > 1 else one


def spark_type(dtype: int, width: int = 1) -> str:
    one = "string" if dtype < 0 else _SPARK.get(dtype, "double")
    return f"array<{one}>" if width > 1 else one


def dummy(dtype: int):
    return "" if dtype < 0 else DUMMY.get(dtype)


def strings(raw: bytes, width: int, n: int) -> pa.Array:
    """``n`` texts of ``width`` bytes, each up to its first NUL; bytes beyond ASCII become U+FFFD."""
    matrix = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    nul = matrix == 0
    lengths = np.where(nul.any(axis=1), nul.argmax(axis=1), width)
    inside = np.arange(width) < lengths[:, None]
    chars = matrix[inside]
    if (chars >= 128).any():
        return pa.array([matrix[i, : lengths[i]].tobytes().decode("ascii", errors="replace") for i in range(n)], pa.string())
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(chars.tobytes()))


def flat_values(raw: bytes, dtype: int, n: int, dummy_as_null: bool) -> pa.Array:
    if dtype < 0:
        return strings(raw, -dtype, n)
    stored = np.frombuffer(raw, STORED[dtype], n)
    mask = stored == np.array(DUMMY[dtype]).astype(STORED[dtype]) if dummy_as_null else None
    values = pa.array(stored, mask=mask) if mask is not None else pa.array(stored)
    return values if values.type == _WIDE[dtype] else values.cast(_WIDE[dtype])


def raw_bytes(survey: SurveyFile, f, channel: Channel, block: np.void) -> tuple[bytes, int | None]:
    """A cell's plain bytes, and the elements that its header declares (None: as many as there are)."""
    offset = int(block["offset"])
    if survey.comp_level:
        f.seek(offset + PACKED_HEADER)
        probe = f.read(8)
        if len(probe) < 8:
            raise codecs.CodecError("the file ends in the block's header", "SHORT_COMPRESSED")
        if probe == codecs.CHUNK_MAGIC:  # declared per file, but each block may be plain
            f.seek(offset + PACKED_HEADER)
            span = int(block["n_pages"]) * survey.header["page_size"] - PACKED_HEADER
            framed = f.read(span)
            if len(framed) < codecs.FRAME:
                raise codecs.CodecError("the file ends in the chunk's header", "SHORT_COMPRESSED")
            if len(framed) < span:  # what there is may still hold the whole stream: only padding is missing then
                survey.note("SHORT_COMPRESSED", f"{len(framed)} of {span} packed bytes are there", offset=offset)
            return codecs.unframe(framed, int(block["total"])), None
    if block["row_count"] < 0:
        raise codecs.CodecError(f"{block['row_count']} rows", "NEGATIVE_ROWS")
    width = -channel.dtype if channel.dtype < 0 else np.dtype(STORED[channel.dtype]).itemsize
    f.seek(offset + BLOCK.itemsize)
    return f.read(int(block["row_count"]) * width), int(block["row_count"])


def decode(survey: SurveyFile, f, channel: Channel, block: np.void, dummy_as_null: bool = False, line: str | None = None) -> pa.Array:
    """The cell's values, an array for each row where the channel is wider than one; empty, with a diagnostic, where they can't be read."""
    kind = arrow_type(channel.dtype, channel.width)
    where = {"line": line, "channel": channel.var_name, "offset": int(block["offset"])}
    if not known(channel.dtype):
        survey.note("UNKNOWN_TYPE", f"type {channel.dtype} can't be decoded", **where)
        return pa.array([], kind)
    try:
        raw, declared = raw_bytes(survey, f, channel, block)
    except codecs.CodecError as e:
        survey.note(e.code, str(e), **where)
        return pa.array([], kind)
    width = -channel.dtype if channel.dtype < 0 else np.dtype(STORED[channel.dtype]).itemsize
    n = len(raw) // width
    if declared is not None and declared > n:
        survey.note("SHORT_DATA", f"{n} of {declared} elements are there", **where)
    n = n if declared is None else min(n, declared)
    if channel.width > 1 and n % channel.width:
        survey.note("RAGGED_ARRAY", f"{n % channel.width} elements beyond the last whole row", **where)
        n -= n % channel.width
    flat = flat_values(raw, channel.dtype, n, dummy_as_null)
    if channel.width == 1:
        return flat
    rows = n // channel.width
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * channel.width), flat)


def padded(values: pa.Array, n: int) -> pa.Array:
    """``values`` with nulls up to ``n`` rows."""
    return values if len(values) == n else pa.concat_arrays([values, pa.nulls(n - len(values), values.type)])


def cast_to(values: pa.Array, kind: pa.DataType) -> pa.Array:
    return values if values.type == kind else pc.cast(values, kind)
