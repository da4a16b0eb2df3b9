"""Sharding by balanced label propagation: linked documents move to where most of their group is, under capacity quotas.

DataFrame functions only. Two documents are linked when their texts are equal; a group is kept as counts by shard, never as
pairs. Law ``rows``: shards differ by one row at most. Room is granted to whole groups, small ones first; a group that was
granted none asks for the best of the shards that still have room for it. Groups that fit no shard, fewer than there are
shards, take what is left, roomiest shard first. Documents without links have no preference, so they are dealt last. The
driver sees numbers for shards, classes of group sizes and buckets, and the groups that fit no shard. Ranks come from counts
of small buckets, so no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import frequent, join_frequent, materialize, table

SHARDS = 8
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 1024
#: Buckets by hash of the groups of one size class that a shard has room for in part.
PARTS = 1024


def _unit(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def _ranked(df: DataFrame, key: str | None, buckets: int) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within each value of ``key``, by row id within hash buckets."""
    df = df.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    keys = [key] if key else []
    sizes = df.groupBy("_b", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_b", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_b", *keys).orderBy("rid")
    return df.withColumn("_r", F.row_number().over(within) - 1).join(base, ["_b", *keys]).withColumn("rank", F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")


def _propagate(groups: DataFrame, room: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """(k1, k2, to) of the groups that a shard takes whole, the groups that fit none, and the room left.

    ``groups`` has k1, k2, n rows, and c rows by shard; ``room`` is the rows that each shard may hold.
    """
    room, settled, left, turn = list(room), groups.select("k1", "k2", F.lit(0).alias("to")).limit(0), groups, 0
    while True:
        fits = [F.when(F.col("n") <= r, F.struct(F.get("c", F.lit(s)).alias("c"), F.xxhash64("k1", "k2", F.lit(s), F.lit(turn)).alias("h"), F.lit(s).alias("s"))) for s, r in enumerate(room)]
        wish = left.select("k1", "k2", "n", "c", F.array_max(F.array(*fits))["s"].alias("to"), F.floor(4 * F.log2("n")).alias("size"), _unit(F.col("k1"), F.col("k2"), F.lit(turn)).alias("u"))
        wish = materialize(wish, "shard-wishes")
        asked = {(r[0], r[1]): r[2] for r in wish.where("to is not null").groupBy("to", "size").agg(F.sum("n")).collect()}
        if not asked:
            return settled, wish.select("k1", "k2", "n"), room
        below, part = F.lit(None).cast("long"), F.lit(None).cast("long")  # classes granted whole, and the bucket in the next one
        partial: dict[int, int] = {}
        for (s, size), n in sorted(asked.items()):
            if s not in partial and n <= room[s]:
                room[s] -= n
            elif s not in partial:
                partial[s] = size
                width = min(1.0, 2 * room[s] / n) / PARTS
                part = F.when((F.col("to") == s) & (F.col("size") == size), F.floor(F.col("u") / width) if width else F.lit(PARTS)).otherwise(part)
        for s, size in partial.items():
            below = F.when(F.col("to") == s, F.lit(size)).otherwise(below)
        edge = dict.fromkeys(partial, 0)
        shut: set[int] = set()
        if partial:
            parts = wish.withColumn("part", part).where(F.col("part") < PARTS).groupBy("to", "part").agg(F.sum("n")).collect()
            for s, p, n in sorted(tuple(r) for r in parts):
                if s not in shut and n <= room[s]:
                    room[s] -= n
                    edge[s] = p + 1
                else:
                    shut.add(s)
        bar = F.lit(0)
        for s, p in edge.items():
            bar = F.when(F.col("to") == s, F.lit(p)).otherwise(bar)
        goes = F.col("to").isNotNull() & F.coalesce((F.col("size") < below) | (F.col("size") == below) & (part < bar), below.isNull())
        settled = settled.unionByName(wish.where(goes).select("k1", "k2", "to"))
        left, turn = wish.where(~goes), turn + 1


def shard(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, linked, shard and slot for each row of ``docs``; counts of shards differ by one at most.

    Null texts count as empty, and empty ones are a group like any other. Rows that repeat and null ids are dealt each. An
    empty table gives an empty result. Columns other than id and text are not read. Rows are told apart by their place in the
    input's partitions, so ties fall otherwise where the same rows are split otherwise into files; the law and the groups hold.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(t).cast("long").alias("bytes"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("k1"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", "k1", (F.col("bytes") * (1 << 32) + F.col("text_crc32")).alias("k2"))
    rows = materialize(rows, "shard-rows")  # row ids are fixed from here on
    total = rows.count()
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rows_by_shard = [F.sum((F.pmod(F.xxhash64("rid"), F.lit(shards)) == s).cast("long")) for s in range(shards)]
    groups = materialize(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.array(*rows_by_shard).alias("c")).where("n > 1"), "shard-groups")
    settled, hot, left = _propagate(groups, room)
    settled = materialize(settled, "shard-settled")
    slices: dict[tuple[int, int], list[tuple[int, int]]] = {}  # of each group that fits no shard: ends of ranks, and shards
    for r in sorted(hot.collect(), key=lambda r: (r["n"], r["k1"], r["k2"])):  # fewer than shards
        end, own = 0, slices.setdefault((r["k1"], r["k2"]), [])
        for s in sorted(range(shards), key=lambda s: -left[s]):
            taken = min(r["n"] - end, left[s])
            left[s] -= taken
            end += taken
            if taken:
                own.append((end, s))
    placed = join_frequent(rows.select("rid", "k1", "k2"), settled, ["k1", "k2"], frequent(rows, "k1")).select("rid", F.col("to").alias("shard"))
    if slices:
        group = F.lit(None).cast("int")
        for g, (k1, k2) in enumerate(slices):
            group = F.when((F.col("k1") == k1) & (F.col("k2") == k2), g).otherwise(group)
        ranked = _ranked(rows.select("rid", group.alias("g")).where("g is not null"), "g", buckets)
        to = F.lit(None).cast("int")
        for g, own in enumerate(slices.values()):
            for end, s in reversed(own):
                to = F.when((F.col("g") == g) & (F.col("rank") < end), s).otherwise(to)
        placed = placed.unionByName(ranked.select("rid", to.alias("shard")))
    placed = materialize(_ranked(materialize(placed, "shard-linked"), "shard", buckets), "shard-placed")
    limit = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("shard") + 1)
    stays = placed.where(F.col("rank") < limit).select("rid", F.col("shard").alias("own"), F.col("rank").alias("slot"))
    held = {r[0]: r[1] for r in stays.groupBy("own").agg(F.count(F.lit(1))).collect()}
    linked_ids = placed.select("rid", F.lit(True).alias("linked"))
    joined = materialize(rows.select("rid", "doc_id", "size", "text_crc32").join(stays, "rid", "left").join(linked_ids, "rid", "left"), "shard-joined")
    pool = _ranked(joined.where("own is null").drop("own", "slot"), None, buckets)
    start, chosen, first = 0, F.lit(shards - 1), F.lit(0)
    for s in range(shards):
        free = room[s] - held.get(s, 0)
        here = (F.col("rank") >= start) & (F.col("rank") < start + free)
        chosen, first = F.when(here, s).otherwise(chosen), F.when(here, F.lit(held.get(s, 0) - start)).otherwise(first)
        start += free
    dealt = pool.select("doc_id", "size", "text_crc32", "linked", chosen.cast("int").alias("shard"), (F.col("rank") + first).cast("long").alias("slot"))
    kept = joined.where("own is not null").select("doc_id", "size", "text_crc32", "linked", F.col("own").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    return kept.unionByName(dealt).withColumn("linked", F.coalesce("linked", F.lit(False)))


def op9_balanced_shards(spark, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
