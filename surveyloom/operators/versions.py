"""Which copy counts: last in order, what a directory says, and what contradicts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import expressions as E


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, with ``copies``. One aggregation with partial maxima, no sort and no window."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_last"), F.count(F.lit(1)).alias("copies"))
    return found.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest], "copies")


def collapse(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value of each key, and whether its copies differ."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, value)).getField(value).alias(value), (F.min(value) != F.max(value)).alias("conflict"))


def resolve(blobs: DataFrame, directory: DataFrame, data_slots: int, region_start: int, page_size: int, slot: str = "blob_index") -> DataFrame:
    """For each slot of ``blobs`` (blob_index, offset, n_pages, chain_pos): live, absent, invalid or outside, and the offset that counts.

    ``directory``: (slot, word, n_pages). An entry is live if it leads to a block of its own slot and size; the last copy
    counts where it is invalid, nothing where it is absent.
    """
    copies = blobs.groupBy(slot).agg(F.max(F.struct("chain_pos", "offset")).getField("offset").alias("last_offset"), F.count(F.lit(1)).alias("copies"))
    entries = directory.where((F.col("word") != 0) | (F.col("n_pages") != 0)).select(F.col("slot").alias(slot), "word", F.col("n_pages").alias("entry_pages"))
    entries = entries.withColumn("target", F.when(E.is_live(F.col("word")), F.lit(region_start) + E.start_page(F.col("word")) * page_size))
    there = blobs.select(slot, F.col("offset").alias("target"), F.col("n_pages").alias("entry_pages"), F.lit(True).alias("there")).distinct()
    joined = copies.join(entries, slot, "left").join(there, [slot, "target", "entry_pages"], "left")
    status = (
        F.when((F.col(slot) < 0) | (F.col(slot) >= data_slots), "outside")
        .when(F.col("word").isNull(), "absent")
        .when(F.col("there"), "live")
        .otherwise("invalid")
    )
    joined = joined.withColumn("status", status)
    offset = F.when(F.col("status") == "live", F.col("target")).when(F.col("status") != "absent", F.col("last_offset"))
    return joined.select(slot, "copies", "status", offset.alias("offset"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each is first."""
    return df.groupBy(value).agg(F.min(order).alias("first_pos"))


def one_or_none(candidates: DataFrame, known: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the one value that is known; null if none is or several are, and which it was.

    ``known`` has a column of the value's name. The groups of all candidates are kept.
    """
    valid = candidates.join(known.select(value).distinct(), value, "left_semi").groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    found = candidates.select(group).distinct().join(valid, group, "left")
    one = F.col("lo") == F.col("hi")
    return found.select(group, F.when(one, F.col("lo")).alias(value), F.coalesce(~one, F.lit(False)).alias("ambiguous"))


def numbered(df: DataFrame, name: str, order: str, by: list[str] | None = None, fold_case: bool = False) -> DataFrame:
    """``occurrence``, ``siblings`` and ``var_name`` of names that repeat: name, name[1], name[2], ... in order."""
    key = F.lower(name) if fold_case else F.col(name)
    w = Window.partitionBy(*(by or []), key)
    out = df.withColumn("occurrence", (F.row_number().over(w.orderBy(order)) - 1).cast("int")).withColumn("siblings", F.count(F.lit(1)).over(w).cast("int"))
    return out.withColumn("var_name", F.when(F.col("occurrence") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("["), F.col("occurrence").cast("string"), F.lit("]"))))


def renamed_reserved(df: DataFrame, name: str, reserved: tuple[str, ...]) -> DataFrame:
    """``column_name``: the name, with ``channel_`` before it where a reserved one is the same but for case."""
    clash = F.lower(name).isin([r.lower() for r in reserved])
    return df.withColumn("column_name", F.when(clash, F.concat(F.lit("channel_"), F.col(name))).otherwise(F.col(name)))
