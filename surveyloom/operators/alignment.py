"""Channels side by side: alignment by station, missing cells, dense fill, long form, runs of pages, slot calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stations(df: DataFrame, keys: list[str], order: list[str], name: str = "fid") -> DataFrame:
    """The place of each row within its key, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def align(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Channels (keys and a value each) side by side by key; where one is shorter or absent, null.

    One aggregation over the union, not a chain of full joins: each value column is null in the other frames' rows.
    """
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in whole.columns if c not in keys]
    return whole.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def stack(frames: list[DataFrame]) -> DataFrame:
    """Frames one after another, with the union of their columns in order of appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing(rows: DataFrame, columns: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a row key and a column key that are not present. ``columns`` is a table of names: a survey's channels."""
    return rows.join(columns).join(present.select(*keys).distinct(), keys, "left_anti")


def dense(df: DataFrame, line: str | list[str], station: str, fills: dict[str, object]) -> DataFrame:
    """Every line with as many stations as the longest has; what isn't there is filled, an array with as many fills as the list says."""
    keys = [line] if isinstance(line, str) else line
    top = df.agg(F.max(station).alias("_top"))
    frame = df.select(*keys).distinct().join(F.broadcast(top)).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_top").cast("int"))).alias(station))
    out = frame.join(df, [*keys, station], "left")
    fill = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return out.select(*keys, station, *[F.coalesce(F.col(f"`{c}`"), fill(v).cast(df.schema[c].dataType)).alias(c) for c, v in fills.items()])


def long_form(df: DataFrame, keys: list[str], channels: list[str], kind: str = "double") -> DataFrame:
    """A row for each cell: keys, channel, value."""
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").cast(kind).alias("value")) for c in channels])
    return df.select(*keys, F.inline(cells))


def runs(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Runs of positions that follow each other: first, and how many. Repeated positions count once."""
    rows = df.select(*keys, position).distinct()
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("length")).drop("_island")


def summary(df: DataFrame, value: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` values, and how many more there are, on each row."""
    more = df.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    return df.orderBy(*order).limit(limit).select(value).join(more)


def calibrate(slots: DataFrame, held: DataFrame, reach: int = 4) -> DataFrame:
    """How many slots meet a held one at each shift, and which shift is chosen: the best, of equals the smallest, then the positive.

    ``slots``, ``held``: a column ``slot`` each.
    """
    shifts = slots.sparkSession.range(-reach, reach + 1).select(F.col("id").cast("int").alias("shift"))
    moved = slots.join(F.broadcast(shifts)).select("shift", (F.col("slot") + F.col("shift")).alias("slot"))  # 2 * reach + 1 rows
    scores = moved.join(held.select("slot").distinct(), "slot", "left_semi").groupBy("shift").agg(F.count(F.lit(1)).alias("score"))
    scores = F.broadcast(shifts).join(scores, "shift", "left").select("shift", F.coalesce("score", F.lit(0)).alias("score"))
    best = scores.agg(F.max_by("shift", F.struct("score", -F.abs("shift"), "shift")).alias("best"))
    return scores.join(F.broadcast(best)).select("shift", "score", (F.col("shift") == F.col("best")).alias("chosen"))


def points(df: DataFrame, x: str, y: str, z: str | None = None, line: list[str] | None = None, station: str = "fid") -> DataFrame:
    """Rows with a place: x, y and z first, the other columns after.

    A line is placed if its x and y are equally long (the place after the last that isn't null); a z of another length is 0 on the
    whole line, as it is without a z channel. Stations beyond x, and those without x or y, are left out. Without x or y
    among the columns nothing is placed.
    """
    by_name = {c.lower(): c for c in df.columns}
    found = [by_name.get(c.lower()) if c else None for c in (x, y, z)]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in found]
    zero = F.lit(0.0)
    if None in found[:2]:
        nowhere = F.lit(None).cast("double")
        return df.where(F.lit(False)).select(nowhere.alias("x"), nowhere.alias("y"), zero.alias("z"), *rest)
    keys = ["line_slot"] if line is None else line
    keys = [k for k in ("path", *keys) if k in df.columns]
    value = [F.col(f"`{c}`").cast("double") if c else None for c in found]
    length = [F.coalesce(F.max(F.when(v.isNotNull(), F.col(station) + 1)), F.lit(0)) if v is not None else F.lit(0) for v in value]
    lengths = df.groupBy(*keys).agg(*[n.alias(f"_n{i}") for i, n in enumerate(length)]).where("_n0 = _n1")
    height = F.when(F.col("_n2") == F.col("_n0"), F.coalesce(value[2], zero)).otherwise(zero) if z and found[2] else zero
    placed = df.join(F.broadcast(lengths), keys).where(value[0].isNotNull() & value[1].isNotNull())  # a row for each line
    return placed.select(value[0].alias("x"), value[1].alias("y"), height.alias("z"), *rest)


def skipped(blobs: DataFrame, live: DataFrame, channels: DataFrame, chans_max: int, data_slots: int) -> DataFrame:
    """How many (line, channel) pairs of each channel have blocks and none that counts."""
    pairs = blobs.where(F.col("blob_index") < data_slots).select("path", "line_slot", "channel_slot").distinct()
    lost = pairs.join(live.select("path", "line_slot", "channel_slot"), ["path", "line_slot", "channel_slot"], "left_anti")
    counts = lost.groupBy("path", "channel_slot").agg(F.count(F.lit(1)).alias("skipped"))
    return counts.join(F.broadcast(channels.select("path", "channel_slot", F.col("name").alias("channel"))), ["path", "channel_slot"])


def extents(cells: DataFrame) -> DataFrame:
    """Of each channel: lines with data, the longest cell, and for strings the longest text."""
    return cells.groupBy("path", "channel_slot", "channel").agg(
        F.count(F.lit(1)).alias("lines"), F.max("n_rows").alias("most_rows"), F.max(F.array_max(F.transform("s", lambda v: F.char_length(v)))).alias("widest")
    )
