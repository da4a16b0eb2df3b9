"""Block codecs of survey files: framed chunks that hold zlib or LZRW1 data, or raw bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format.
CHUNK_MAGIC = bytes.fromhex("0f0efffe12345678")
SPEED, SIZE = 1, 2
PACKED, STORED = -186263865, -253635901

FRAME = 16  # magic, subtype, reserved
_LINK = struct.Struct("<iii")  # bytes out, bytes of this link with these twelve, marker
MOST_CHUNK = 200_000_000
MOST_RATIO = 9  # no LZRW1 stream gets smaller than a ninth


class CodecError(ValueError):
    """The bytes are not what their frame says. ``code`` names the diagnostic."""

    def __init__(self, message: str, code: str = "LZRW1_FAIL"):
        super().__init__(message)
        self.code = code


def lzrw1(data: bytes, at: int, size: int) -> bytes:
    """``size`` bytes from the LZRW1 stream that begins at ``at``: groups of sixteen literals or copies under a control word."""
    out = bytearray()
    end, plain = len(data), 0
    while len(out) < size:
        if at + 2 > end:
            raise CodecError(f"input ends after {len(out)} of {size} bytes")
        control = int.from_bytes(data[at : at + 2], "little")
        at += 2
        if control == 0 and size - len(out) >= 16:  # sixteen literals
            if at + 16 > end:
                raise CodecError(f"input ends after {len(out)} of {size} bytes")
            out += data[at : at + 16]
            at += 16
            plain += 1
            if plain > 1:  # such groups come in runs: take as many as there are at once
                groups = np.ndarray((min((size - len(out)) // 16, (end - at) // 18, 4096), 18), np.uint8, data, at)
                heads = np.flatnonzero(groups[:, 0] | groups[:, 1])
                n = int(heads[0]) if len(heads) else len(groups)
                out += groups[:n, 2:].tobytes()
                at += 18 * n
            continue
        plain = 0
        if size - len(out) >= 256 and at + 32 <= end:  # neither can end within this group
            left = 16
            while left:
                literals = (control & -control).bit_length() - 1 if control else left
                if literals:
                    out += data[at : at + literals]
                    at += literals
                    left -= literals
                    control >>= literals
                if not left:
                    break
                high = data[at]
                back, n = (high & 0xF0) << 4 | data[at + 1], (high & 0x0F) + 1
                at += 2
                left -= 1
                control >>= 1
                if not 0 < back <= len(out):
                    raise CodecError(f"copy from {back} bytes back, of {len(out)}")
                start = len(out) - back
                out += out[start : start + n] if n <= back else (out[start:] * (n // back + 1))[:n]  # a copy may run into what it writes
            continue
        for bit in range(16):
            room = size - len(out)
            if not room:
                break
            if control >> bit & 1:
                if at + 2 > end:
                    raise CodecError(f"input ends after {len(out)} of {size} bytes")
                high, low = data[at], data[at + 1]
                at += 2
                back, n = (high & 0xF0) << 4 | low, min((high & 0x0F) + 1, room)
                if not 0 < back <= len(out):
                    raise CodecError(f"copy from {back} bytes back, of {len(out)}")
                piece = bytes(out[len(out) - back : len(out) - back + n])
                out += (piece * (n // len(piece) + 1))[:n]  # a copy may run into what it writes
            else:
                if at >= end:
                    raise CodecError(f"input ends after {len(out)} of {size} bytes")
                out.append(data[at])
                at += 1
    return bytes(out)


def _link(data: bytes, at: int) -> tuple[bytes, int]:
    """What the link at ``at`` holds, and where the next begins."""
    if at + _LINK.size > len(data):
        raise CodecError(f"no room for a chunk header at {at} of {len(data)}")
    size, span, marker = _LINK.unpack_from(data, at)
    if not 0 < size < MOST_CHUNK:
        raise CodecError(f"implausible chunk of {size} bytes")
    body = at + _LINK.size
    if marker == STORED:
        if span - _LINK.size != size:
            raise CodecError(f"stored chunk of {size} bytes spans {span}")
        if body + size > len(data):
            raise CodecError(f"stored chunk of {size} bytes is cut off")
        return data[body : body + size], at + span
    if marker != PACKED:
        raise CodecError(f"unknown chunk marker {marker}")
    return lzrw1(data, body, size), at + span


def speed_blob(data: bytes, total: int) -> bytes:
    """All links of a framed LZRW1 blob; ``total`` is what the blob's header declares, 0 or less if unknown (then the first link counts)."""
    if total > MOST_RATIO * max(len(data), 1):
        raise CodecError(f"{total} bytes declared from {len(data)}")
    if len(data) < FRAME + _LINK.size:
        raise CodecError(f"{len(data)} bytes are too few for a chunk")
    piece, at = _link(data, FRAME)
    parts, made = [piece], len(piece)
    while made < total:
        if at <= FRAME + _LINK.size - 1:
            raise CodecError("a chunk that doesn't advance")
        before = at
        piece, at = _link(data, at)
        if at - before < _LINK.size:
            raise CodecError("a chunk that doesn't advance")
        parts.append(piece)
        made += len(piece)
    if total > 0 and made > total and len(parts) > 1:
        raise CodecError(f"{made} bytes, of {total} declared")
    return b"".join(parts)


def unframe(data: bytes, total: int) -> bytes:
    """The plain bytes of a framed blob: ``data`` begins with the chunk magic."""
    subtype = int.from_bytes(data[8:12], "little", signed=True)
    if subtype == SIZE:
        stream = zlib.decompressobj()
        try:
            out = stream.decompress(data[FRAME:])  # what follows the stream is padding
        except zlib.error as e:
            raise CodecError(f"zlib: {e}", "ZLIB_FAIL") from e
        if not stream.eof:
            raise CodecError(f"zlib: the stream ends after {len(out)} bytes", "ZLIB_FAIL")
        return out
    if subtype == SPEED:
        return speed_blob(data, total)
    raise CodecError(f"unknown chunk subtype {subtype}", "UNKNOWN_SUBTYPE")


def speed_chunks(data: bytes) -> list[tuple[int, int | None, int | None, int | None]]:
    """(offset, bytes out, span, marker) of each framed LZRW1 chunk found anywhere in ``data``; nulls for a frame that is cut off."""
    out, at = [], data.find(CHUNK_MAGIC)
    while at >= 0:
        if at + 12 > len(data) or int.from_bytes(data[at + 8 : at + 12], "little", signed=True) == SPEED:
            cut = at + FRAME + _LINK.size > len(data)
            out.append((at, None, None, None) if cut else (at, *_LINK.unpack_from(data, at + FRAME)))
        at = data.find(CHUNK_MAGIC, at + 1)
    return out
