"""Survey files as they arrive in a folder: a stream of the rows that ``survey`` gives for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from surveyloom.sources import share
from surveyloom.sources.survey import Lines, SurveyReader


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A stream of rows of the survey files in ``folder``. Spark's file stream keeps what it has seen; contents are read where the file is.

    ``schema`` is that of ``survey`` (``spark.read.format("survey").load(one_file).schema``).
    """
    share(spark)
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_trigger:
        seen = seen.option("maxFilesPerTrigger", files_per_trigger)
    paths = seen.load(folder).select("path")
    lowered = {k.lower(): v for k, v in options.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = SurveyReader(schema, {**lowered, "path": path})
                yield from reader.read(Lines(path, None))

    return paths.mapInArrow(rows, schema)
