"""Where things are in a survey file: header, symbol tables, block chain, live-version directory.

All symbol tables are runs of 128-byte records that begin with a name: block symbols, then lines, channels, users. Tables
are read as arrays of records; what the file can't support becomes a row of diagnostics, never an exception, but for a
file that isn't a survey at all where the caller asked to be told.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyarrow import fs

# Fixed values of the format.
MAGIC = b"!CBD"
SIGNATURE = bytes.fromhex("21434244000000000000021008010000")
BLOCK_MAGIC = b"\xcc\xcc\x00\xff"
HEADER_WORDS = {"chans_max": 24, "blobs_max": 28, "lines_max": 36, "users_max": 40, "index_slots": 44, "data_slots": 48, "page_size": 100, "comp_level": 120}
START_PAGE = 108
DIRECTORY = 280
RECORD = 128
LIVE_BIT, PAGE_MASK = 0x80000000, 0x3FFFFFFF
LINE_CATEGORIES = {100: "NORMAL", 200: "GROUP"}
ADMIN_BYTES = 50_000_000
SCAN_BYTES = 1 << 20

CHANNEL = np.dtype({"names": ["name", "dtype", "basetype", "format", "display_width", "decimals", "f100", "i108", "width"], "formats": ["V64", "<i2", "<i2", "<i2", "<i2", "<i4", "<f8", "<i2", "<i2"], "offsets": [0, 76, 78, 84, 86, 88, 100, 108, 110], "itemsize": RECORD})
LINE = np.dtype({"names": ["name", "category", "type", "block"], "formats": ["V64", "<i4", "<i4", "V20"], "offsets": [0, 76, 96, 104], "itemsize": RECORD})
SYMBOL = np.dtype({"names": ["name", "category", "i116"], "formats": ["V64", "<i4", "<i4"], "offsets": [0, 76, 116], "itemsize": RECORD})
BLOCK = np.dtype([("magic", "S4"), ("n_pages", "<i4"), ("n_pages_dup", "<i4"), ("index", "<i4"), ("timestamp", "<i4"), ("class", "<i4"), ("total", "<i4"), ("span", "<i4"), ("scale", "<f8"), ("row_count", "<i4"), ("gs_type", "<i4")])
ENTRY = np.dtype([("word", "<u4"), ("n_pages", "<u2")])
PACKED_HEADER = 56


def open_file(path: str):
    """A random-access file of any store that Arrow knows: local paths and URIs (file, hdfs, s3, gs)."""
    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def clean_name(raw: bytes) -> tuple[str, bool]:
    """A name field's text, and whether it is closed by a NUL and printable throughout."""
    text, closed, _ = raw.partition(b"\0")
    return text.decode("ascii", errors="replace"), bool(closed) and all(32 <= b < 127 for b in text)


@dataclass
class Channel:
    slot: int
    name: str
    dtype: int
    format: int
    basetype: int
    width: int
    display_width: int
    decimals: int
    clean: bool
    raw: bytes
    occurrence: int = 0
    siblings: int = 1

    @property
    def var_name(self) -> str:
        return self.name if not self.occurrence else f"{self.name}[{self.occurrence}]"


@dataclass
class Line:
    slot: int
    name: str
    category: int
    type: int
    block: bytes
    occurrence: int = 0
    siblings: int = 1


@dataclass
class Diagnostic:
    code: str
    message: str
    line: str | None = None
    channel: str | None = None
    offset: int | None = None


def number_names(items: list) -> None:
    """Which of the items with its name each one is, in table order."""
    seen: dict[str, list] = {}
    for x in items:
        own = seen.setdefault(x.name, [])
        x.occurrence = len(own)
        own.append(x)
    for own in seen.values():
        for x in own:
            x.siblings = len(own)


@dataclass
class SurveyFile:
    """One file, read as far as asked; each part is read once."""

    path: str
    include_unlisted: bool = False
    diagnostics: list[Diagnostic] = field(default_factory=list)

    def __post_init__(self) -> None:
        with open_file(self.path) as f:
            self.size = f.size()
            self.head = f.read(4096)
        self.is_survey = self.head[:4] == MAGIC
        if not self.is_survey:
            self.note("BAD_MAGIC", "the file doesn't begin with the survey magic")

    def note(self, code: str, message: str, **where) -> None:
        self.diagnostics.append(Diagnostic(code, message, **where))

    def read(self, offset: int, n: int) -> bytes:
        with open_file(self.path) as f:
            f.seek(offset)
            return f.read(n)

    @cached_property
    def header(self) -> dict[str, int | None]:
        out: dict[str, int | None] = {}
        for name, at in HEADER_WORDS.items():
            out[name] = struct.unpack_from("<i", self.head, at)[0] if at + 4 <= len(self.head) else None
        if self.is_survey and None in out.values():
            self.note("HEADER_TRUNCATED", f"{len(self.head)} bytes hold no {', '.join(k for k, v in out.items() if v is None)}")
        return out

    @property
    def comp_level(self) -> int:
        return self.header["comp_level"] or 0

    @cached_property
    def region_start(self) -> int | None:
        if len(self.head) < START_PAGE + 4:
            return None
        return struct.unpack_from("<i", self.head, START_PAGE)[0] * struct.unpack_from("<i", self.head, HEADER_WORDS["page_size"])[0]

    @cached_property
    def tables(self) -> bytes:
        """All that stands before the blocks, where the symbol tables are."""
        start = self.region_start
        if start is not None and 0 < start <= self.size:
            return self.read(0, start)
        return self.read(0, self.size if self.size <= 200_000_000 else 20_000_000)

    @cached_property
    def channels_at(self) -> int | None:
        """The first channel record: so many records before the first user, whose name is the anchor."""
        n = self.header["chans_max"]
        if not self.is_survey or n is None:
            return None
        for m in re.finditer(rb"SUPER|super", self.tables):
            at = m.start() - n * RECORD
            if at < 8 or len(self.tables) < at + RECORD - 8:
                continue
            name, clean = clean_name(self.tables[at : at + 64])
            if name and clean:
                return at
        self.note("CHANNEL_TABLE_NOT_FOUND", "no user record implies a channel table")
        return None

    def _records(self, at: int, n: int, kind: np.dtype) -> np.ndarray:
        """Up to ``n`` records; the last one's tail may be missing by the eight bytes that no field uses."""
        raw = self.tables[at : at + n * RECORD]
        whole = (len(raw) + 8) // RECORD
        return np.frombuffer(raw[: whole * RECORD].ljust(whole * RECORD, b"\0"), kind)[:n]

    @cached_property
    def channels(self) -> list[Channel]:
        out: list[Channel] = []
        if self.channels_at is None:
            return out
        n = self.header["chans_max"]
        found = self._records(self.channels_at, n, CHANNEL)
        if len(found) < n:
            self.note("CHANNEL_TABLE_TRUNCATED", f"{len(found)} of {n} channel records are there")
        for slot, r in enumerate(found):
            name, clean = clean_name(r["name"].tobytes())
            dtype, form, width = int(r["dtype"]), int(r["format"]), int(r["width"])
            if name and clean and (0 <= dtype <= 13 or -256 <= dtype <= -1) and 0 <= form <= 6 and width >= 1:
                out.append(Channel(slot, name, dtype, form, int(r["basetype"]), width, int(r["display_width"]), int(r["decimals"]), clean, r.tobytes()))
        number_names(out)
        return out

    def _line(self, slot: int, r: np.void) -> Line | None:
        name, clean = clean_name(r["name"].tobytes())
        if name and clean and int(r["category"]) in LINE_CATEGORIES:
            return Line(slot, name, int(r["category"]), int(r["type"]), r["block"].tobytes())
        return None

    @cached_property
    def _lines(self) -> tuple[list[Line], bool]:
        n = self.header["lines_max"]
        if not self.is_survey:
            return [], False
        if n and n > 0 and self.channels_at is not None:
            at = self.channels_at - n * RECORD
            if at >= 256 + 32:
                found = [x for slot, r in enumerate(self._records(at, n, LINE)) if (x := self._line(slot, r))]
                if found:
                    return found, True
        return self._lines_by_shape(), False

    def _lines_by_shape(self) -> list[Line]:
        """Lines of a file whose table isn't where the header says: records that look like lines, on their commonest phase."""
        data = self.tables
        starts = np.array([m.start() for m in re.finditer(rb"[\x20-\x7e]{1,63}\0", data) if m.start() >= 160 and m.start() + RECORD - 32 <= len(data)], np.int64)
        if len(starts):
            words = np.frombuffer(data, np.uint8)
            category = np.array([int.from_bytes(words[s + 76 : s + 80].tobytes(), "little") for s in starts])
            starts = starts[np.isin(category, list(LINE_CATEGORIES))]
        if not len(starts):
            self.note("LINE_TABLE_NOT_FOUND", "nothing looks like a line record")
            return []
        phases, first, counts = np.unique(starts % RECORD, return_index=True, return_counts=True)
        best = min(range(len(phases)), key=lambda i: (-counts[i], first[i]))
        at = int(starts[starts % RECORD == phases[best]].min())
        out: list[Line] = []
        strange = 0
        for slot in range((len(data) - at + 32) // RECORD):
            r = np.frombuffer(data[at + slot * RECORD : at + (slot + 1) * RECORD].ljust(RECORD, b"\0"), LINE)[0]
            line = self._line(slot, r)
            name, clean = clean_name(r["name"].tobytes())
            strange = 0 if line or not name and clean else strange + 1
            if line:
                out.append(line)
            if strange == 8:
                break
        return out

    @cached_property
    def lines(self) -> list[Line]:
        """Real lines, numbered as the blocks number them."""
        lines, exact = self._lines
        if lines and not exact and len(self.blocks):
            held = set((self.blocks["index"] // self.header["chans_max"]).tolist()) if self.header["chans_max"] else set()
            shift = max(range(-4, 5), key=lambda o: (sum(x.slot + o in held for x in lines), -abs(o), o))
            for x in lines:
                x.slot += shift
        number_names(lines)
        return lines

    @property
    def lines_exact(self) -> bool:
        return self._lines[1]

    @cached_property
    def users(self) -> np.ndarray:
        n = self.header["users_max"]
        if self.channels_at is None or not n or n < 0:
            return np.zeros(0, SYMBOL)
        return self._records(self.channels_at + self.header["chans_max"] * RECORD, n, SYMBOL)

    @cached_property
    def blocks(self) -> np.ndarray:
        """The headers of the block chain, in its order, with ``offset``; pages that begin no block are passed over."""
        kind = np.dtype([("offset", "<i8"), *[(n, BLOCK[n]) for n in BLOCK.names]])
        rows: list[tuple] = []
        at, page = self.region_start, self.header["page_size"]
        if not self.is_survey or at is None or not page or page <= 0 or at < 0:
            return np.zeros(0, kind)
        if at > self.size:
            self.note("CHAIN_START_PAST_EOF", f"blocks would begin at {at} of {self.size} bytes")
            return np.zeros(0, kind)
        skipped: list[tuple[int, int]] = []
        last = None
        with open_file(self.path) as f:
            while at + BLOCK.itemsize <= self.size:
                f.seek(at)
                r = np.frombuffer(f.read(BLOCK.itemsize), BLOCK)[0]
                if bytes(r["magic"]).ljust(4, b"\0") != BLOCK_MAGIC:
                    nxt = self._next_block(f, at + page, page)
                    if nxt is None:
                        self.note("MAGIC_MISMATCH", f"no block begins at {at} or on a later page, after {len(rows)}", offset=at)
                        at = last = None
                        break
                    skipped.append((at, (nxt - at) // page))
                    at = nxt
                    continue
                if r["n_pages"] <= 0:
                    self.note("BAD_NPAGES", f"a block of {r['n_pages']} pages, after {len(rows)}", offset=at)
                    at = last = None
                    break
                rows.append((at, *r.tolist()))
                last = r
                at += int(r["n_pages"]) * page
        if skipped:
            shown = ", ".join(f"{n} at {a}" for a, n in skipped[:5]) + (f" and {len(skipped) - 5} more" if len(skipped) > 5 else "")
            self.note("PAGES_SKIPPED", f"{sum(n for _, n in skipped)} pages begin no block ({shown})", offset=skipped[0][0])
        if last is not None and at > self.size:
            self.note("PAST_EOF", f"the last block ends {at - self.size} bytes past the file", offset=rows[-1][0])
        elif last is not None and at != self.size:
            rest = self.read(at, self.size - at)
            if BLOCK_MAGIC.startswith(rest[: len(BLOCK_MAGIC)]):
                self.note("MID_HEADER", f"the file ends {len(rest)} bytes into a block's header, after {len(rows)}", offset=at)
            else:
                self.note("SLACK", f"{len(rest)} bytes after the last block", offset=at)
        return np.array(rows, kind)

    def _next_block(self, f, at: int, page: int) -> int | None:
        pages = max(1, SCAN_BYTES // page)
        while at + BLOCK.itemsize <= self.size:
            f.seek(at)
            buffer = f.read(pages * page)
            for i in range(0, len(buffer), page):
                if buffer[i : i + 4] == BLOCK_MAGIC and at + i + BLOCK.itemsize <= self.size:
                    return at + i
            at += pages * page
        return None

    @cached_property
    def directory(self) -> np.ndarray | None:
        """Entries of all data slots, or None where the file has no directory that can be trusted."""
        h = self.header
        n = h["data_slots"]
        if not self.is_survey or None in (h["chans_max"], h["lines_max"], n, h["page_size"]) or self.region_start is None:
            return None
        if n <= 0 or n != h["lines_max"] * h["chans_max"] or DIRECTORY + n * ENTRY.itemsize > self.region_start:
            return None
        raw = self.read(DIRECTORY, n * ENTRY.itemsize)
        if len(raw) < n * ENTRY.itemsize:
            return None
        found = np.frombuffer(raw, ENTRY)
        return found if (found["word"] != 0).any() or (found["n_pages"] != 0).any() else None

    @cached_property
    def symbols(self) -> dict[int, str] | None:
        """Names of live administrative objects by slot; None where there is no such table."""
        n, slots = self.header["blobs_max"], self.header["index_slots"]
        if not self.is_survey or not n or not slots or n <= 0 or slots <= 0 or self.region_start is None:
            return None
        at = DIRECTORY + slots * ENTRY.itemsize
        if at + n * RECORD > self.region_start:
            return None
        raw = self.read(at, n * RECORD)
        if len(raw) < n * RECORD:
            return None
        out = {}
        for slot, r in enumerate(np.frombuffer(raw, SYMBOL)):
            name, clean = clean_name(r["name"].tobytes())
            if r["category"] == 0 and name and clean:
                out[slot] = name
        return out

    def adopt(self, lines: list[Line], live: dict[tuple[int, int], np.void]) -> None:
        """Takes what another reader of the file found, so that the chain of blocks isn't walked again."""
        self.__dict__.update(lines=lines, live=live)

    @cached_property
    def live(self) -> dict[tuple[int, int], np.void]:
        """The current block of each (line slot, channel slot)."""
        chans = self.header["chans_max"]
        blocks = self.blocks
        if not chans or not len(blocks):
            return {}
        copies: dict[tuple[int, int], list[np.void]] = {}
        for b in blocks:
            copies.setdefault(divmod(int(b["index"]), chans), []).append(b)
        out = {k: v[-1] for k, v in copies.items()}
        real = {x.slot: x.name for x in self.lines}
        if not real:
            return out
        names = {c.slot: c.name for c in self.channels}
        if self.directory is None:
            for k, v in copies.items():
                if len(v) > 1 and k[0] in real:
                    self.note("DUPLICATE_NO_DIRECTORY", f"{len(v)} blocks and no directory; the last one counts", line=real[k[0]], channel=names.get(k[1]))
            return out
        by_offset = {int(b["offset"]): b for b in blocks}
        page, start = self.header["page_size"], self.region_start
        for k in copies:
            if k[0] not in real:
                continue
            slot = k[0] * chans + k[1]
            word, pages = (int(self.directory[slot][n]) for n in ("word", "n_pages")) if 0 <= slot < len(self.directory) else (0, 0)
            found = by_offset.get(start + (word & PAGE_MASK) * page) if word & LIVE_BIT else None
            if not 0 <= slot < len(self.directory):
                continue
            if not word and not pages:
                self.note("UNLISTED_SKIPPED", "the directory lists no live block", line=real[k[0]], channel=names.get(k[1]))
                if not self.include_unlisted:
                    del out[k]
            elif found is not None and int(found["index"]) == slot and int(found["n_pages"]) == pages:
                out[k] = found
            else:
                self.note("DIRECTORY_INVALID", "the directory's entry leads to no such block; the last copy counts", line=real[k[0]], channel=names.get(k[1]))
        return out

    def on_line(self, line: Line) -> list[tuple[Channel, np.void]]:
        """Channels with data on a line, in table order."""
        return [(c, b) for c in self.channels if (b := self.live.get((line.slot, c.slot))) is not None and b["row_count"] >= 0]

    @cached_property
    def admin_objects(self) -> dict[int, bytes]:
        """The current bytes of each administrative object by slot: where the directory leads, else its last copy."""
        h = self.header
        if None in (h["data_slots"], h["page_size"], h["blobs_max"]) or self.region_start is None or not h["page_size"]:
            return {}
        own = [b for b in self.blocks if b["index"] >= h["data_slots"]]
        chosen = {int(b["index"]) - h["data_slots"]: b for b in own}
        by_offset = {int(b["offset"]): b for b in own}
        raw = self.read(DIRECTORY + ENTRY.itemsize * h["data_slots"], ENTRY.itemsize * max(0, h["blobs_max"]))
        entries = np.frombuffer(raw[: len(raw) // ENTRY.itemsize * ENTRY.itemsize], ENTRY)
        for slot in np.flatnonzero(entries["word"] & LIVE_BIT).tolist():
            b = by_offset.get(self.region_start + (int(entries["word"][slot]) & PAGE_MASK) * h["page_size"])
            if b is not None and b["index"] == h["data_slots"] + slot and b["n_pages"] == entries["n_pages"][slot]:
                chosen[slot] = b
        out = {}
        with open_file(self.path) as f:
            for slot, b in chosen.items():
                data = self.block_bytes(f, b)
                if len(data) >= 28:
                    out[slot] = payload(data)
        return out

    def block_bytes(self, f, block: np.void) -> bytes:
        f.seek(int(block["offset"]))
        return f.read(min(int(block["n_pages"]) * self.header["page_size"], ADMIN_BYTES))


def payload(data: bytes) -> bytes:
    """A block's bytes up to the end that it declares."""
    return data[: max(28, min(len(data), 28 + struct.unpack_from("<i", data, 24)[0]))]
