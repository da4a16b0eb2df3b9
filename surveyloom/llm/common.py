"""Shared plumbing of the corpus operators: tables, scratch tables in the shared folder, bounded training samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a folder of the warehouse where that is unset on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/") if root else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    left = 0
    for spark, path in _written:
        try:
            _delete(spark, path)
        except (Py4JError, AttributeError, OSError):  # the session has ended before
            left += 1
    if left:
        print(f"{left} scratch tables are left, the first is {_written[0][1]}", file=sys.stderr)


atexit.register(_clean)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, and survives lost executors.

    The files are deleted by ``discard``, or when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()`` as a table; the scratch tables that were written on the way to it are deleted."""
    before = set(_written)
    out = materialize(make(), label)
    for spark, path in set(_written) - before - {(out.sparkSession, out._scratch)}:
        _written.remove((spark, path))
        _delete(spark, path)
    sweep(out.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more: what was made from them is a table itself."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path and (df.sparkSession, path) in _written:
            _written.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of queries that have ended: it does when their plans are collected, which a driver with room puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows from which a join key is frequent; the most frequent keys, so many at most, are dealt with.
HOT_ROWS, MOST_HOT = 1 << 10, 1 << 14


def frequent(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys that more than ``hot_rows`` rows of ``df`` have, the ``MOST_HOT`` most frequent; None if there are none. Counts are summed before the shuffle."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    found = materialize(counts.orderBy(F.desc("n")).limit(MOST_HOT).select(key), "frequent-keys")
    if found.limit(1).collect():
        return found
    discard(found)
    return None


def join_frequent(many: DataFrame, one: DataFrame, key: str | list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key at most; rows whose (first) key is ``hot`` are not shuffled."""
    if hot is None:
        return many.join(one, key, how)
    first = key if isinstance(key, str) else key[0]
    few = F.broadcast(one.join(F.broadcast(hot), first, "left_semi"))  # MOST_HOT rows at most
    own = many.join(F.broadcast(hot), first, "left_semi").join(few, key, how)
    return own.unionByName(many.join(F.broadcast(hot), first, "left_anti").join(one, key, how))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def unit_hash(column: str) -> Column:
    """A number in [0, 1) that depends on the column alone."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 30)) / float(1 << 30)


def sample_ids(ids: DataFrame, label: str, per_label: int, id_col: str = "doc_id", max_labels: int | None = 256) -> dict:
    """At most ``per_label`` ids of each label, chosen by the id's hash; labels beyond the ``max_labels`` commonest are not learned (None: all are).

    Counting covers every row; the bound is on what the driver gathers. Null ids and labels are not learned from.
    """
    ids = ids.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    counts = ids.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)
    counts = (counts if max_labels is None else counts.limit(max_labels)).collect()
    if not counts:
        return {}
    rates = ids.sparkSession.createDataFrame([(row[0], 1.2 * per_label / row["n"]) for row in counts], f"`{label}` {dict(ids.dtypes)[label]}, _rate double")
    rows = ids.join(F.broadcast(rates), label).where(unit_hash(id_col) < F.col("_rate")).select(id_col, label, unit_hash(id_col).alias("u")).distinct()
    chosen: dict = {row[0]: [] for row in counts}
    for row in sorted(rows.collect(), key=lambda r: (r["u"], r[0])):
        if len(chosen[row[1]]) < per_label:
            chosen[row[1]].append(row[0])
    return {k: v for k, v in chosen.items() if v}


def fetch_texts(docs: DataFrame, ids: dict, max_bytes: int, text_col: str = "text", id_col: str = "doc_id", at_least_one: bool = False) -> dict[object, list[str]]:
    """The texts of ``sample_ids``' ids, whole, as many of each label as fit in its share of ``max_bytes``; with ``at_least_one``, the shortest where none fits."""
    if not ids:
        return {}
    spark = docs.sparkSession
    share = max_bytes // len(ids)
    wanted = [i for v in ids.values() for i in v]
    listed = spark.createDataFrame([(i,) for i in wanted], f"{id_col} {dict(docs.dtypes)[id_col]}")
    docs = docs.select(id_col, text_col).where(F.col(text_col).isNotNull())
    listed = F.broadcast(listed)  # bounded: per_label ids of at most max_labels labels
    sizes = {r[0]: r[1] for r in docs.join(listed, id_col).groupBy(id_col).agg(F.max(F.octet_length(text_col))).collect()}
    kept: dict = {}
    for label, own in ids.items():
        left = share
        for i in own:
            if i in sizes and sizes[i] <= left:
                left -= sizes[i]
                kept[i] = label
        known = [i for i in own if i in sizes] if at_least_one else []
        if known and not any(kept.get(i) == label for i in known):
            kept[min(known, key=sizes.__getitem__)] = label
    if not kept:
        return {}
    listed = F.broadcast(spark.createDataFrame([(i,) for i in kept], f"{id_col} {dict(docs.dtypes)[id_col]}"))
    out: dict = {}
    for r in sorted(docs.join(listed, id_col).distinct().collect(), key=lambda r: (r[0], r[1])):
        out.setdefault(kept[r[0]], []).append(r[1])
    return out


class BitTable:
    """One bit for each hash value: says of a number that it is not in a set, or that it may be. Its size is bounded, whatever the set's."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def of(values: DataFrame, column: str, most_bits: int = 1 << 28) -> BitTable:
        """Of a column of integers, nulls left out; 16 bits for each row up to ``most_bits`` in all."""
        bits = 1 << 16
        while bits < min(most_bits, 16 * values.count()):
            bits *= 2
        spot = BitTable.spot(column, bits) + 1
        segments = values.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(spot).alias("s")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("b"))
        table = np.zeros(bits // 8, np.uint8)
        for row in segments.collect():  # 4 KB each, ``bits`` in all
            start = (row["s"] - 1) * 4096
            own = np.frombuffer(bytes(row["b"]), np.uint8)[: len(table) - start]
            table[start : start + len(own)] = own
        return BitTable(table, bits)

    @staticmethod
    def spot(column: str, bits: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits))

    def may_hold(self, spots: np.ndarray) -> np.ndarray:
        at = np.maximum(spots, 0)
        return (spots < 0) | ((self.table[at >> 3] >> (at & 7)) & 1 == 1)

    def probed(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the column's place in the table, for ``may_hold``; a null's is -1."""
        return df.withColumn(name, F.when(F.col(column).isNotNull(), self.spot(column, self.bits)).otherwise(-1))

    def flag(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with a boolean column: whether the table may hold the column's value; a null always may."""
        handle = df.sparkSession.sparkContext.broadcast(self)
        probe = long_rows(self.probed(df, column, name))
        names = probe.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.columns[-1].to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(handle.value.may_hold(at))], names=names)

        return probe.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))


def long_rows(df: DataFrame) -> DataFrame:
    """``df``, for a map over Arrow batches of texts: batches of a tenth of Spark's default rows, unless the session has its own."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a map over batches; at its end the worker gives what has become free back to the system, which idle workers would hold."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return mapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each, so that what is made of them stays small; a row is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
