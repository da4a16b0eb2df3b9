"""``survey``: rows of survey files, one for each line and station; ``survey_cells``: one for each line and channel.

A file's chain of blocks is walked by header only. Lines are packed into input partitions by pages; within one, channels of
a line are read together and aligned by station. With many files each file is a partition and is walked by its executor,
so that planning costs one listing.

Options: ``lines`` (names, comma-separated), ``channels`` (column names), ``includeUnlisted``, ``dummyAsNull``,
``partitionBytes``, ``filesAsPartitions`` (from so many files on, each file is a partition). A schema given by the user
selects columns: only their channels are decoded. With ``pushdown`` set and ``spark.sql.python.filterPushdown.enabled`` on,
equality filters on ``line``, ``line_category`` and ``line_slot`` select lines before anything is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructField, StructType

from surveyloom.functions import cells
from surveyloom.functions.layout import LINE_CATEGORIES, Channel, Line, SurveyFile, open_file

RESERVED = ("path", "line", "line_category", "line_slot", "fid")
ROWS = 65536
PARTITION_BYTES = 48 << 20
FILES_AS_PARTITIONS = 64
SCHEMA_THREADS = 16


def list_files(path: str, suffixes: tuple[str, ...] = ()) -> list[str]:
    """The files at a path, or in the directory that it names, by name; a comma separates several."""
    out = []
    for p in path.split(","):
        store, inner = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            prefix = p[: len(p) - len(inner)] if p.endswith(inner) else ""
            found = [x.path for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
            out += sorted(prefix + x for x in found if not suffixes or x.endswith(suffixes))
        else:
            out.append(p)
    return out


def column_names(survey: SurveyFile) -> dict[int, str]:
    """Column of each channel slot that has data on a line, in the order in which lines and then channels bring them up.

    A repeated name gets its occurrence, a name that the source uses itself gets ``channel_`` before it. Spark doesn't tell
    names by case, so neither does this.
    """
    out: dict[int, str] = {}
    taken = set(RESERVED)
    again: dict[str, int] = {}
    for line in survey.lines:
        for c, _ in survey.on_line(line):
            if c.slot in out:
                continue
            name = c.var_name
            if name.lower() in RESERVED:
                survey.note("NAME_RESERVED", f"the column is named channel_{name}", channel=name)
                name = f"channel_{name}"
            base = name
            while name.lower() in taken:
                again[base.lower()] = again.get(base.lower(), 0) + 1
                name = f"{base}[{again[base.lower()]}]"
            if name != base:
                survey.note("CASE_COLLISION", f"the column is named {name}", channel=c.var_name)
            if c.siblings > 1:
                survey.note("NAME_DUPLICATE", f"one of {c.siblings} channels of that name", channel=c.var_name)
            taken.add(name.lower())
            out[c.slot] = name
    return out


def field_metadata(c: Channel) -> dict:
    return {
        "channel": c.name, "channel_slot": c.slot, "occurrence": c.occurrence, "type_code": c.dtype, "type_name": cells.type_name(c.dtype), "format_name": cells.FORMAT_NAMES.get(c.format, f"unknown({c.format})"),
        "array_width": c.width, "array_basetype_name": cells.BASETYPE_NAMES.get(c.basetype, f"unknown({c.basetype})"), "display_width": c.display_width, "decimals": c.decimals, "dummy": str(cells.dummy(c.dtype)),
    }


_TYPES = {"byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "decimal(20,0)": T.DecimalType(20, 0)}


def spark_type(name: str) -> T.DataType:
    """A type by its name; planning workers have no session that could parse one."""
    return T.ArrayType(_TYPES[name[6:-1]], False) if name.startswith("array<") else _TYPES[name]


_RANK = ["byte", "short", "int", "long", "decimal(20,0)"]


def common_type(a: str, b: str, name: str) -> str:
    """The type that holds both; files of one directory may differ in width, not in kind."""
    if a == b:
        return a
    inner = lambda t: t[6:-1] if t.startswith("array<") else t
    if a.startswith("array<") != b.startswith("array<") or "string" in (inner(a), inner(b)):
        raise ValueError(f"column {name} is {a} in one file and {b} in another")
    x, y = inner(a), inner(b)
    wide = _RANK[max(_RANK.index(x), _RANK.index(y))] if x in _RANK and y in _RANK else "double"
    return f"array<{wide}>" if a.startswith("array<") else wide


def is_true(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def names_of(options: dict, name: str) -> set[str] | None:
    """A list option: JSON, or names with commas between."""
    value = options.get(name)
    if value is None:
        return None
    return set(json.loads(value)) if value.lstrip().startswith("[") else {x.strip() for x in value.split(",")}


class Lines(InputPartition):
    """Some lines of a file with their blocks and column names, or (lines None) all of them, to be found by whoever reads."""

    def __init__(self, path: str, lines: list[Line] | None, survey: SurveyFile | None = None, names: dict[int, str] | None = None):
        self.path, self.lines, self.names = path, lines, names
        slots = {x.slot for x in lines or ()}
        self.live = {k: b for k, b in survey.live.items() if k[0] in slots} if survey else {}


class SurveyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.files = list_files(options["path"])
        self.lines, self.categories, self.slots, self.paths = names_of(self.options, "lines"), None, None, None
        self.dummy_as_null = is_true(self.options, "dummyasnull")

    def survey(self, path: str) -> SurveyFile:
        return SurveyFile(path, is_true(self.options, "includeunlisted"))

    def wanted(self, survey: SurveyFile) -> list[Line]:
        keep = lambda x: (self.lines is None or x.name in self.lines) and (self.categories is None or LINE_CATEGORIES[x.category] in self.categories) and (self.slots is None or x.slot in self.slots)
        return [x for x in survey.lines if keep(x)]

    def partitions(self) -> list[InputPartition]:
        files = [p for p in self.files if self.paths is None or p in self.paths]
        if len(files) >= int(self.options.get("filesaspartitions", FILES_AS_PARTITIONS)):
            return [Lines(p, None) for p in files]
        most = int(self.options.get("partitionbytes", PARTITION_BYTES))
        out: list[InputPartition] = []
        for path in files:
            survey = self.survey(path)
            names = column_names(survey)
            page = survey.header["page_size"] or 1
            now, size = [], 0
            for line in self.wanted(survey):
                own = sum(int(b["n_pages"]) for _, b in survey.on_line(line)) * page
                if now and size + own > most:
                    out.append(Lines(path, now, survey, names))
                    now, size = [], 0
                now.append(line)
                size += own
            if now:
                out.append(Lines(path, now, survey, names))
        return out or [Lines("", [])]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        survey, lines = self.opened(partition)
        names = column_names(survey) if partition.names is None else partition.names
        with open_file(partition.path) as f:
            for line in lines:
                yield from self.rows(survey, f, line, names)

    def opened(self, partition: Lines) -> tuple[SurveyFile, list[Line]]:
        """The partition's file and lines; of the file only its tables are read where the partition knows the blocks."""
        survey = self.survey(partition.path)
        if partition.lines is None:
            return survey, self.wanted(survey)
        survey.adopt(partition.lines, partition.live)
        return survey, partition.lines

    def rows(self, survey: SurveyFile, f, line: Line, names: dict[int, str]) -> Iterator[pa.RecordBatch]:
        asked = {x.name for x in self.schema.fields}
        own = survey.on_line(line)
        columns: dict[str, pa.Array] = {}
        n = 0
        for c, block in own:
            if names[c.slot] in asked or int(block["offset"]) + int(block["n_pages"]) * survey.header["page_size"] > survey.size:
                columns[names[c.slot]] = cells.decode(survey, f, c, block, self.dummy_as_null, line.name)
        n = max([0, *map(len, columns.values())])
        n = max([n, *(self.height(survey, c, b) for c, b in own if names[c.slot] not in columns)])
        fixed = {"path": survey.path, "line": line.name, "line_category": LINE_CATEGORIES[line.category]}
        for start in range(0, n, ROWS):
            rows = min(ROWS, n - start)
            out = []
            for x in self.schema.fields:
                if x.name in fixed:
                    out.append(pa.array([fixed[x.name]], pa.string()).take(pa.array(np.zeros(rows, np.int32))))
                elif x.name == "line_slot":
                    out.append(pa.array(np.full(rows, line.slot, np.int32)))
                elif x.name == "fid":
                    out.append(pa.array(np.arange(start, start + rows, dtype=np.int32)))
                else:
                    kind = _arrow(x)
                    values = columns.get(x.name)
                    piece = pa.nulls(rows, kind) if values is None else cells.padded(cells.cast_to(values.slice(start, rows), kind), rows)
                    out.append(piece)
            yield pa.RecordBatch.from_arrays(out, names=[x.name for x in self.schema.fields])

    @staticmethod
    def height(survey: SurveyFile, c: Channel, block: np.void) -> int:
        """Rows of a cell that is not decoded, by its header; a packed block holds them behind the plain header's end."""
        if not cells.known(c.dtype):
            return 0
        rows = int(block["row_count"])
        if survey.comp_level and block["class"] == 202:
            width = -c.dtype if c.dtype < 0 else np.dtype(cells.STORED[c.dtype]).itemsize
            rows = max(0, int(block["total"])) // width
        return rows // c.width


class PushingSurveyReader(SurveyReader):
    def pushFilters(self, filters):  # noqa: N802  the API's name
        for x in filters:
            values = {x.value} if isinstance(x, EqualTo) else set(x.value) if isinstance(x, In) else None
            column = x.attribute[0] if values is not None and len(x.attribute) == 1 else None
            if column in ("line", "line_category", "line_slot", "path"):
                slot = {"line": "lines", "line_category": "categories", "line_slot": "slots", "path": "paths"}[column]
                before = getattr(self, slot)
                setattr(self, slot, values if before is None else before & values)
            else:
                yield x


def _arrow(x: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(x.dataType)


class SurveySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "survey"

    def schema(self) -> StructType:
        kinds: dict[str, tuple[str, dict]] = {}
        with ThreadPoolExecutor(SCHEMA_THREADS) as pool:  # reading waits for the store
            for found in pool.map(self._columns, list_files(self.options["path"])):
                for name, kind, metadata in found:
                    old = kinds.get(name)
                    kinds[name] = (common_type(old[0], kind, name) if old else kind, old[1] if old else metadata)
        only = names_of(self.options, "channels")
        fields = [StructField(n, spark_type(t)) for n, t in (("path", "string"), ("line", "string"), ("line_category", "string"), ("line_slot", "int"), ("fid", "int"))]
        return StructType(fields + [StructField(n, spark_type(t), metadata=m) for n, (t, m) in kinds.items() if only is None or n in only])

    def _columns(self, path: str) -> list[tuple[str, str, dict]]:
        survey = SurveyFile(path, is_true(self.options, "includeunlisted"))
        by_slot = {c.slot: c for c in survey.channels}
        return [(name, cells.spark_type(by_slot[slot].dtype, by_slot[slot].width), field_metadata(by_slot[slot])) for slot, name in column_names(survey).items()]

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingSurveyReader if is_true(self.options, "pushdown") else SurveyReader)(schema, self.options)


class CellsReader(SurveyReader):
    """Natural lengths and repeated names, as they are: nothing is aligned or renamed."""

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        survey, lines = self.opened(partition)
        only = names_of(self.options, "channels")
        with open_file(partition.path) as f:
            for line in lines:
                for c, block in survey.on_line(line):
                    if only is not None and c.name not in only and c.var_name not in only:
                        continue
                    values = cells.decode(survey, f, c, block, self.dummy_as_null, line.name)
                    n, flat = len(values), values.flatten() if c.width > 1 else values
                    own = {"path": survey.path, "line": line.name, "line_slot": line.slot, "channel": c.name, "var_name": c.var_name, "channel_slot": c.slot, "type_code": c.dtype, "array_width": c.width, "n_rows": n}
                    kind = "s" if c.dtype < 0 else "u" if c.dtype == 9 else "f" if c.dtype in (4, 5) else "i"
                    lists = {"i": pa.int64(), "f": pa.float64(), "u": pa.decimal128(20, 0), "s": pa.string()}
                    out = []
                    for x in self.schema.fields:
                        if x.name in lists:
                            if x.name == kind and cells.known(c.dtype):
                                items = cells.cast_to(flat, lists[kind])
                                out.append(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items))
                            else:
                                out.append(pa.nulls(1, pa.list_(lists[x.name])))
                        else:
                            out.append(pa.array([own[x.name]], _arrow(x)))
                    yield pa.RecordBatch.from_arrays(out, names=[x.name for x in self.schema.fields])


class CellsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "survey_cells"

    def schema(self) -> str:
        return "path string, line string, line_slot int, channel string, var_name string, channel_slot int, type_code int, array_width int, n_rows int, i array<bigint>, f array<double>, u array<decimal(20,0)>, s array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CellsReader(schema, self.options)
