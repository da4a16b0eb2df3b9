"""One survey file by name: the metadata is read by the driver (it is small), everything else is a DataFrame."""

from __future__ import annotations

import json
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import sources
from surveyloom.functions import cells
from surveyloom.functions.layout import LINE_CATEGORIES, Channel, Line, SurveyFile
from surveyloom.operators import alignment, registry
from surveyloom.sources.survey import column_names

Ref = str | tuple[str, int]


class Survey:
    """``Survey(spark, path)``; raises ValueError where the file is no survey."""

    def __init__(self, spark: SparkSession, path: str, include_unlisted: bool = False, dummy_as_null: bool = False):
        sources.register(spark)
        self.spark, self.path, self.file = spark, path, SurveyFile(path, include_unlisted)
        self.options = {"includeUnlisted": str(include_unlisted).lower(), "dummyAsNull": str(dummy_as_null).lower()}
        self._tables: dict[tuple, DataFrame] = {}
        if not self.file.is_survey:
            raise ValueError(f"{path}: not a survey file")

    # names

    @property
    def channels(self) -> list[Channel]:
        return self.file.channels

    @property
    def lines(self) -> list[Line]:
        return self.file.lines

    @property
    def channel_names(self) -> list[str]:
        return [c.name for c in self.channels]

    @property
    def line_names(self) -> list[str]:
        return [x.name for x in self.lines]

    @staticmethod
    def _pick(items: list, ref: Ref, what: str):
        name, which = ref if isinstance(ref, tuple) else (ref, None)
        own = [x for x in items if x.name == name]
        if not own:
            raise KeyError(f"no {what} named {name!r}")
        if which is not None:
            if not 0 <= which < len(own):
                raise IndexError(f"{len(own)} {what}s are named {name!r}, there is no occurrence {which}")
            return own[which]
        if len(own) > 1:
            raise ValueError(f"{len(own)} {what}s are named {name!r}; ask for (name, occurrence)")
        return own[0]

    def channel(self, ref: Ref) -> Channel:
        return self._pick(self.channels, ref, "channel")

    def line(self, ref: Ref) -> Line:
        return self._pick(self.lines, ref, "line")

    def channel_on_line(self, line: Ref, ref: Ref) -> Channel:
        """A repeated name is the one that has data on the line."""
        if isinstance(ref, tuple):
            return self.channel(ref)
        own = [c for c in self.channels if c.name == ref]
        if not own:
            raise KeyError(f"no channel named {ref!r}")
        there = [c for c, _ in self.file.on_line(self.line(line)) if c.name == ref]
        if len(own) > 1 and len(there) > 1:
            raise ValueError(f"{len(there)} channels named {ref!r} have data on the line; ask for (name, occurrence)")
        return there[0] if there else own[0]

    def channels_on_line(self, line: Ref) -> list[str]:
        return [c.name for c, _ in self.file.on_line(self.line(line))]

    # data

    def _load(self, source: str, **options: str) -> DataFrame:
        return self.spark.read.format(source).options(**self.options, **options).load(self.path)

    def cells(self, line: Ref | None = None) -> DataFrame:
        """A row for each line and channel, of its own length, repeated names as they are."""
        if line is None:
            return self._load("survey_cells")
        one = self.line(line)
        return self._load("survey_cells", lines=json.dumps([one.name])).where(F.col("line_slot") == one.slot)

    def read(self, line: Ref, channel: Ref) -> DataFrame:
        """(fid, value) of one cell; no rows where the line has no such data."""
        one, c = self.line(line), self.channel_on_line(line, channel)
        if (one.slot, c.slot) not in self.file.live:
            self.file.note("CELL_ABSENT", "this line has no data of that channel", line=one.name, channel=c.var_name)
        found = self._load("survey_cells", lines=json.dumps([one.name]), channels=json.dumps([c.var_name])).where((F.col("line_slot") == one.slot) & (F.col("channel_slot") == c.slot))
        kind = "s" if c.dtype < 0 else "u" if c.dtype == 9 else "f" if c.dtype in (4, 5) else "i"
        if c.width == 1:
            return found.select(F.posexplode(kind).alias("fid", "value"))
        rows = F.sequence(F.lit(0), F.col("n_rows") - 1)
        return found.where("n_rows > 0").select(F.posexplode(F.transform(rows, lambda i: F.slice(F.col(kind), i * c.width + 1, c.width))).alias("fid", "value"))

    def to_dataframe(self, line: Ref | None = None, channels: list[str] | None = None) -> DataFrame:
        """A row for each line and station. Only the asked channels are decoded."""
        options = {} if channels is None else {"channels": json.dumps(channels)}
        if line is None:
            return self._load("survey", **options)
        one = self.line(line)
        return self._load("survey", lines=json.dumps([one.name]), **options).where(F.col("line_slot") == one.slot)

    @cached_property
    def _columns(self) -> dict[str, Channel]:
        by_slot = {c.slot: c for c in self.channels}
        return {name: by_slot[slot] for slot, name in column_names(self.file).items()}

    def dense(self) -> DataFrame:
        """Every line (by slot: names may repeat) with as many stations as the longest has, missing values by each type's mark."""
        fills = {name: cells.dummy(c.dtype) if c.width == 1 else [cells.dummy(c.dtype)] * c.width for name, c in self._columns.items()}
        keys = ["line_slot", "line", "line_category"]
        return alignment.dense(self.to_dataframe().select(*keys, "fid", *[F.col(f"`{c}`") for c in fills]), keys, "fid", fills)

    def points(self, x: str | None = None, y: str | None = None, z: str | None = None) -> DataFrame:
        """Rows with a place, by the channels given, else by registered roles, else Easting and Northing; see ``alignment.points``."""
        roles = self._roles
        x, y, z = x or roles.get("X") or "Easting", y or roles.get("Y") or "Northing", z or roles.get("Z")
        return alignment.points(self.to_dataframe(), x, y, z)

    def write_points(self, target: str, x: str | None = None, y: str | None = None, z: str | None = None, file_format: str = "parquet") -> None:
        """``points`` as files that Spark can write, a folder for each line category."""
        self.points(x, y, z).write.partitionBy("line_category").format(file_format).save(target)

    @cached_property
    def _roles(self) -> dict[str, str | None]:
        return {r["role"]: r["channel"] for r in self.coordinate_channels().collect()}

    def line_table(self, line: Ref) -> "pandas.DataFrame":  # noqa: F821, UP037
        """One line on the driver, with what the file says about the line and its channels as ``attrs``."""
        one = self.to_dataframe(line)
        found = one.drop("path", "line", "line_category", "line_slot").orderBy("fid").toPandas().set_index("fid")
        found.attrs = self.attributes(line) | {"channels": {f.name: f.metadata for f in one.schema.fields if f.metadata}}
        return found

    def blocks(self, line: Ref, channel: Ref) -> DataFrame:
        """All copies of one cell's block, in the order of the chain."""
        at = self.line(line).slot * self.file.header["chans_max"] + self.channel(channel).slot
        return self.catalog("blobs").where(F.col("blob_index") == at).orderBy("chain_pos")

    def block(self, line: Ref, channel: Ref) -> DataFrame:
        """The first copy of one cell's block; no row where there is none."""
        return self.blocks(line, channel).limit(1)

    def absent_cells(self) -> DataFrame:
        """Pairs of a line and a channel that were never recorded."""
        lines = self.catalog("lines").select("path", "line_slot", F.col("name").alias("line"))
        channels = F.broadcast(self.catalog("channels").select("path", "channel_slot", F.col("name").alias("channel")))
        return lines.join(channels, "path").join(self.catalog("live_blobs").select("path", "line_slot", "channel_slot"), ["path", "line_slot", "channel_slot"], "left_anti")

    def skipped(self) -> DataFrame:
        """How many cells of each channel have blocks that the directory doesn't list."""
        return alignment.skipped(self.catalog("blobs"), self.catalog("live_blobs"), self.catalog("channels"), self.file.header["chans_max"], self.file.header["data_slots"])

    def extents(self) -> DataFrame:
        return alignment.extents(self.cells())

    def flattened(self) -> DataFrame:
        """``to_dataframe`` with a column for each element of array channels."""
        from surveyloom.functions.expressions import flattened

        wide = self.to_dataframe()
        widths = {name: c.width for name, c in self._columns.items()}
        return wide.select(*[col for name in wide.columns for col in (flattened(name, widths[name]) if widths.get(name, 1) > 1 else [F.col(f"`{name}`")])])

    # what the file says about itself

    def catalog(self, table: str, **options: str) -> DataFrame:
        """A table of the source ``survey_catalog``; its plan is made once."""
        key = (table, *sorted(options.items()))
        if key not in self._tables:
            self._tables[key] = self._load("survey_catalog", table=table, **options)
        return self._tables[key]

    def attributes(self, line: Ref | None = None) -> dict[str, str]:
        if line is None:
            return {"path": self.path}
        one = self.line(line)
        return {"line_name": one.name, "line_category": LINE_CATEGORIES[one.category], "path": self.path}

    def coordinate_systems(self) -> DataFrame:
        return registry.coordinate_systems(self.catalog("crs_entries"))

    def coordinate_channels(self) -> DataFrame:
        return registry.channel_roles(self.catalog("role_entries"), self.catalog("channels"))

    def channel_settings(self) -> DataFrame:
        return registry.channel_settings(self.catalog("setting_entries"))

    def channel_makers(self) -> DataFrame:
        return registry.channel_makers(self.catalog("maker_entries"))

    def display_lists(self) -> DataFrame:
        return self.catalog("display_entries").orderBy("list_no", "pos")

    def projection_parameters(self) -> DataFrame:
        return registry.projections(self.catalog("projection_entries"), self.catalog("projection_texts"))

    def diagnostics(self, validate: bool = False) -> DataFrame:
        """What the file's tables and blocks, its registry, and reads of absent cells have brought up."""
        found = self.catalog("diagnostics", validate=str(validate).lower())
        absent = [(self.path, d.code, d.line, d.channel, d.offset, d.message) for d in self.file.diagnostics if d.code == "CELL_ABSENT"]
        notes = self.spark.createDataFrame(absent, found.schema) if absent else None
        told = registry.findings(self.channel_settings(), self.projection_parameters(), self.channel_makers(), self.coordinate_channels())
        return reduce(DataFrame.unionByName, [found, told, *([notes] if notes is not None else [])])

    def conformance(self) -> DataFrame:
        return self.catalog("conformance")
