"""``survey_grid``: cells of grid files; ``survey_grid_headers``: their headers, with what reading them finds.

A packed grid is read by block, a plain one by runs of vectors; each is an input partition, which carries the file's plan.
From ``filesAsPartitions`` files on each file is one and is planned by its executor. Values are raw: scale, rotation and
ordering are columns of the header. With the option ``coordinates``, x and y are added from origin, spacing and rotation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from surveyloom.functions import grids
from surveyloom.functions.layout import open_file
from surveyloom.sources.survey import FILES_AS_PARTITIONS, SCHEMA_THREADS, is_true, list_files

ROWS = 1 << 16
_VALUE = {"<i1": "byte", "<u1": "short", "<i2": "short", "<u2": "int", "<i4": "int", "<u4": "long", "<f4": "float", "<f8": "double"}


class Part(InputPartition):
    """One part of a planned grid, or (grid None) all of them, to be planned by whoever reads."""

    def __init__(self, path: str, index: int = 0, grid: grids.Grid | None = None):
        self.path, self.index, self.grid = path, index, grid


class GridReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.files = list_files(options["path"])

    def plan(self, path: str) -> grids.Grid:
        return grids.plan(path, int(self.options.get("partitionbytes", 32 << 20)))

    def partitions(self) -> list[InputPartition]:
        if len(self.files) >= int(self.options.get("filesaspartitions", FILES_AS_PARTITIONS)):
            return [Part(p) for p in self.files]
        with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
            return [Part(g.path, i, g) for g in pool.map(self.plan, self.files) for i in range(len(g.parts))] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        grid = partition.grid or self.plan(partition.path)
        for index in range(len(grid.parts)) if partition.grid is None else [partition.index]:
            with open_file(partition.path) as f:
                if grid.packed:  # blocks after one that can't be decoded don't count
                    for before in grid.parts[:index]:
                        if before[3] < 0 or before[2] + before[3] > f.size():
                            return
                values = grids.read_part(grid, grid.parts[index], f)
            if values is None:
                return
            yield from self.rows(grid, values, *grid.parts[index][:2])

    def rows(self, grid: grids.Grid, values: np.ndarray, first: int, n: int) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for start in range(0, min(n, len(values)), ROWS):
            own = values[start : min(n, len(values), start + ROWS)]
            at = first + start + np.arange(len(own), dtype=np.int64)
            v, e = np.divmod(at, max(1, grid.shape_e))
            mask = own == np.array(grid.dummy).astype(grid.dtype) if is_true(self.options, "dummyasnull") else None
            made = {"grid_row": pa.array(v.astype(np.int32)), "grid_col": pa.array(e.astype(np.int32)), "value": pa.array(own, mask=mask)}
            turn = math.radians(grid.rotation)
            along, across = e * grid.spacing_e, v * grid.spacing_v
            if abs(grid.ordering) == 1:  # elements run along x; otherwise along y
                dx, dy = along, across
            else:
                dx, dy = across, along
            made["x"] = pa.array(grid.x_origin + dx * math.cos(turn) - dy * math.sin(turn))
            made["y"] = pa.array(grid.y_origin + dx * math.sin(turn) + dy * math.cos(turn))
            made["path"] = pa.array([grid.path], pa.string()).take(pa.array(np.zeros(len(own), np.int32)))
            yield pa.RecordBatch.from_arrays([made[x.name].cast(to_arrow_type(x.dataType)) for x in self.schema.fields], names=[x.name for x in self.schema.fields])


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "survey_grid"

    def schema(self) -> str:
        with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
            kinds = {_VALUE[g.dtype] for g in pool.map(grids.plan, list_files(self.options["path"]))}
        kind = next(iter(kinds)) if len(kinds) == 1 else "double"
        extra = ", x double, y double" if is_true(self.options, "coordinates") else ""
        return f"path string, grid_row int, grid_col int, value {kind}{extra}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(schema, self.options)


class GridHeaderReader(GridReader):
    def partitions(self) -> list[InputPartition]:
        return [Part(p) for p in self.files] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.path:
            return
        g = self.plan(partition.path)
        notes = [d.code for d in g.diagnostics]
        if is_true(self.options, "validate"):
            with open_file(partition.path) as f:
                decoded = 0
                for part in g.parts:
                    values = grids.read_part(g, part, f)
                    if values is None:
                        notes.append("GRID_BLOCK")
                        break
                    decoded += min(len(values), part[1])
            if decoded != g.shape_e * g.shape_v and "GRID_COUNT" not in notes:
                notes.append("GRID_COUNT")
        row = {"path": g.path, "element_size": g.element, "is_compressed": g.packed, "sign_flag": g.sign, "shape_e": g.shape_e, "shape_v": g.shape_v, "ordering": g.ordering, "spacing_e": g.spacing_e, "spacing_v": g.spacing_v, "x_origin": g.x_origin, "y_origin": g.y_origin, "rotation": g.rotation, "base_value": g.base_value, "data_factor": g.data_factor, "dummy": float(g.dummy), "diagnostics": notes}
        yield tuple(row[x.name] for x in self.schema.fields)


class GridHeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "survey_grid_headers"

    def schema(self) -> str:
        return "path string, element_size int, is_compressed boolean, sign_flag int, shape_e int, shape_v int, ordering int, spacing_e double, spacing_v double, x_origin double, y_origin double, rotation double, base_value double, data_factor double, dummy double, diagnostics array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridHeaderReader(schema, self.options)
