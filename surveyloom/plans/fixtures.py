"""Survey and grid files over the plain tables: rows of known tables, written once for each session and folder of tables."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.plans import encode

_made: dict[tuple, str] = {}
CHANNELS = [("order_key", 8, 1), ("cust_key", 8, 1), ("status", -1, 1), ("total_price", 5, 1), ("order_us", 8, 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    root = root.rstrip("/")
    return ("file://" + root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root) + "/survey-fixtures"


def written(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """The path of a file that ``make()`` gives the bytes of, or the survey to be written."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        own = hashlib.sha1(f"{key[0]}|{sf_dir}".encode()).hexdigest()[:12]
        path = f"{folder(spark)}/{own}/{name}"
        store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        made = make()
        with store.open_output_stream(inner) as f:
            encode.write(made, f) if isinstance(made, encode.Survey) else f.write(made)
        _made[key] = inner if path.startswith("file:") or "://" not in path else path
    return _made[key]


_ORDERS = {"order_key": "o_orderkey", "cust_key": "o_custkey", "status": "o_orderstatus", "total_price": "o_totalprice", "order_us": "us"}


def orders_of(spark: SparkSession, sf_dir: str, line: str) -> dict[str, pa.ChunkedArray]:
    """Columns of the ``orders`` of one priority, by key."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == line).withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)"))
    found = rows.orderBy("o_orderkey").select(*_ORDERS.values()).toArrow()
    return {k: found[v] for k, v in _ORDERS.items()}


def orders_survey(spark: SparkSession, sf_dir: str, name: str, edit=None, **options) -> str:
    """All orders, a line for each priority; ``edit(survey)`` changes it, a line's cells at a time, before it is written."""

    def make() -> encode.Survey:
        names = sorted(r[0] for r in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect())
        lines = [(line, 100) for line in names]

        def feed():
            for i, line in enumerate(names):
                data = orders_of(spark, sf_dir, line)
                cells = {(i, j): data[c] if c == "status" else data[c].to_numpy() for j, (c, _, _) in enumerate(CHANNELS)}
                one = encode.Survey(list(CHANNELS), lines, cells, **options)
                if edit:
                    edit(one)
                yield one.cells, one.stale

        s = encode.Survey(list(CHANNELS), lines, {}, **options)
        if edit:
            edit(s)  # what it says of the file
        s.feed = feed
        return s

    return written(spark, sf_dir, f"{name}.survey", make)


def sparse_survey(spark: SparkSession, sf_dir: str) -> str:
    def make() -> bytes:
        rows = table(spark, sf_dir, "orders").orderBy("o_orderstatus", "o_orderkey").toArrow()
        status = rows["o_orderstatus"].to_numpy(zero_copy_only=False)
        lines = sorted(set(status))
        cells = {(i, 0): rows["o_orderkey"].to_numpy()[status == x] for i, x in enumerate(lines)}
        cells |= {(i, 1): rows["o_custkey"].to_numpy()[status == x] for i, x in enumerate(lines) if x == "O"}
        return encode.encode(encode.Survey([("order_key", 8, 1), ("cust_key", 8, 1)], [(x, 100) for x in lines], cells))

    return written(spark, sf_dir, "sparse.survey", make)


def embeddings_survey(spark: SparkSession, sf_dir: str) -> str:
    def make() -> bytes:
        rows = table(spark, sf_dir, "embeddings").orderBy("label", "vec_id").toArrow()
        label = rows["label"].to_numpy()
        vectors = np.array(rows["embedding"].to_pylist(), np.float32)
        lines = sorted(set(label.tolist()))
        cells = {}
        for i, x in enumerate(lines):
            cells[i, 0], cells[i, 1] = rows["vec_id"].to_numpy()[label == x], vectors[label == x].ravel()
        return encode.encode(encode.Survey([("vec_id", 8, 1), ("embedding", 4, vectors.shape[1])], [(f"E{x}", 100) for x in lines], cells))

    return written(spark, sf_dir, "embeddings.survey", make)


def types_survey(spark: SparkSession, sf_dir: str) -> str:
    """A channel of each numeric type: least, greatest, missing, 1."""
    from surveyloom.functions import cells as C

    def make() -> bytes:
        channels, cells = [], {}
        for code, kind in C.STORED.items():
            t = np.dtype(kind)
            top = (np.iinfo(t).min, np.iinfo(t).max) if t.kind in "iu" else (-0.5, 0.5)
            channels.append((f"t{code}", code, 1))
            cells[0, code] = np.array([top[0], top[1], C.DUMMY[code], 1], dtype=t)
        return encode.encode(encode.Survey(channels, [("T", 100)], cells))

    return written(spark, sf_dir, "types.survey", make)


def names_survey(spark: SparkSession, sf_dir: str) -> str:
    """Repeated, reserved and case-only different names."""

    def make() -> bytes:
        channels = [("mag", 5, 1), ("mag", 5, 1), ("Mag", 5, 1), ("line", 3, 1), ("FID", 3, 1), ("nothing", 5, 1)]
        cells = {(0, j): np.array([j, j + 10]) for j in range(5)} | {(1, 1): np.array([100, 101, 102])}
        return encode.encode(encode.Survey(channels, [("L1", 100), ("L2", 200)], cells))

    return written(spark, sf_dir, "names.survey", make)


def registry_survey(spark: SparkSession, sf_dir: str) -> str:
    """Settings, roles, projections, creation records and a display list, with stale copies."""

    def make() -> bytes:
        channels = [("raw_mag", 5, 1), ("Easting", 5, 1), ("Northing", 5, 1)]
        s = encode.Survey(channels, [("L100", 100)], {(0, j): np.arange(3.0) for j in range(3)})
        s.objects = [("", b"")] * 11
        h = [encode.handle(s, j) for j in range(3)]
        number = [int(x[2:]) for x in h]
        record = encode.maker("newchan.gx", "New channel", [("CHANNEL", "raw_mag"), ("EXPR", "a=b")])
        s.objects = [
            (h[0], encode.reg([("UNITS", "old"), ("LABEL", "Raw magnetics")])),
            (h[0], encode.reg([("UNITS", "nT"), ("EMPTY", "")])),
            (h[1], encode.reg([("UNITS", "m"), ("SPARE", "x")], spare=1)),
            ("roles", encode.reg([("DB_CHAN_X", "Easting"), ("DB_CHAN_Y", "Northing"), ("DB_CHAN_Z", "Gone")])),
            ("crs", encode.projection("WGS 84 / UTM zone 54S", 11, [0.0, 141.0, None, None, 0.9996, 500000.0, 10000000.0, None])),
            ("crs2", encode.projection("Amersfoort / RD New", 99, [52.15616055555555, 5.38763888888889, None, None, 0.9999079, 155000.0, 463000.0, None])),
            ("text", encode.reg([("_PJ_NAME", '"Amersfoort / RD New"'), ("_PJ_PROJECTION", '"Oblique Stereographic",52.15616055555555,5.38763888888889,0.9999079,155000,463000')])),
            ("bad text", encode.reg([("_PJ_NAME", '"WGS 84 / UTM zone 54S"'), ("_PJ_PROJECTION", '"Transverse Mercator",1,2,3,4,5')])),
            (h[0], encode.reg([("UNITS", "nT")], nested=record)),
            ("Display List", encode.display_list([("raw_mag", number[0]), ("lost", number[2] + 40)])),
            ("Other", encode.reg([("KEY", "value")])),
        ]
        return encode.encode(s)

    return written(spark, sf_dir, "registry.survey", make)


def nation_grid(spark: SparkSession, sf_dir: str, packed: bool) -> str:
    """Customers of each nation and market segment, as a grid of nations by segments."""

    def make() -> bytes:
        rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").count().collect()
        segments = sorted({r[1] for r in rows})
        values = np.zeros((25, len(segments)))
        for nation, segment, n in rows:
            values[nation, segments.index(segment)] = n
        return encode.grid(values, packed, per_block=7, origin=(100.0, 200.0))

    return written(spark, sf_dir, f"nation-{packed}.grid", make)


def repeated_survey(spark: SparkSession, sf_dir: str) -> str:
    """Two lines of one name, and an array channel that one of them lacks."""

    def make() -> bytes:
        cells = {(0, 0): np.array([1.0, 2.0]), (0, 1): np.arange(6.0), (1, 0): np.array([5.0, 6.0, 7.0]), (2, 0): np.array([9.0])}
        return encode.encode(encode.Survey([("mag", 5, 1), ("depths", 5, 3)], [("L1", 100), ("L1", 100), ("L2", 200)], cells))

    return written(spark, sf_dir, "repeated.survey", make)


def places_survey(spark: SparkSession, sf_dir: str) -> str:
    """Lines whose coordinates are whole, of unequal length, without heights, and with heights of another length."""

    def make() -> bytes:
        channels = [("Easting", 5, 1), ("Northing", 5, 1), ("alt", 5, 1), ("mag", 5, 1)]
        lengths = [(2, 2, 2, 3), (2, 1, 2, 2), (2, 2, 0, 2), (2, 2, 1, 1)]
        cells = {(i, j): np.arange(n) + 10.0 * i + 100.0 * j for i, own in enumerate(lengths) for j, n in enumerate(own) if n}
        return encode.encode(encode.Survey(channels, [(f"L{i}", 100) for i in range(4)], cells))

    return written(spark, sf_dir, "places.survey", make)


def odd_survey(spark: SparkSession, sf_dir: str) -> str:
    """Places that hold something else than conforming files do: one of each kind."""

    def make() -> bytes:
        s = encode.Survey([("mag", 5, 1)], [("L100", 100)], {(0, 0): np.arange(3.0)}, users=2)
        s.objects = [("", b"")] * 4
        record = bytearray(encode.maker("a.gx", "A", []))
        at = record.index(b"a.gx\0") + 5
        record[at : at + 2] = b"\x07\0"
        last = encode.projection("P", 11, [0.0, 1.0, None, None, 1.0, 2.0, 3.0, 4.0])
        s.objects = [
            (encode.handle(s, 0), encode.reg([("UNITS", "nT")], nested=bytes(record))),
            ("crs", last),
            ("crs2", encode.projection("Q", 77, [None] * 8)),
            ("Database Extension Objects", struct.pack("<i", 84) + b"\0" * 16 + b"EXT\0" + b"\0" * 64),
        ]
        data = bytearray(encode.encode(s))
        data[16:20] = struct.pack("<i", 9)  # a header word
        channel = data.index(b"mag\0")
        data[channel + 108 : channel + 110] = struct.pack("<h", 6)
        line = data.index(b"L100\0")
        data[line + 96 : line + 100], data[line + 104] = struct.pack("<i", 3), 0
        return bytes(data)

    return written(spark, sf_dir, "odd.survey", make)


def broken_surveys(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Files with one thing wrong each, by what it is."""
    page = encode.PAGE

    def plain(**options) -> encode.Survey:
        return encode.Survey([("mag", 5, 1), ("text", -4, 1)], [("L1", 100), ("L2", 100)], {(i, j): np.arange(300.0) if j == 0 else ["ab"] * 300 for i in range(2) for j in range(2)}, **options)

    def patched(at: int, raw: bytes, block: int | None = None, **options) -> bytes:
        data = bytearray(encode.encode(plain(**options)))
        if block is not None:
            for _ in range(block + 1):
                start = data.index(encode.BLOCK_MAGIC, 0 if not _ else start + 4)
            at += start
        data[at : at + len(raw)] = raw
        return bytes(data)

    def last_block(data: bytes) -> int:
        return data.rindex(encode.BLOCK_MAGIC)

    whole, packed = encode.encode(plain()), encode.encode(plain(comp_level=2))
    rng = np.random.default_rng(0)
    noise = {(0, 0): rng.random(2000)}
    zipped = encode.encode(encode.Survey([("mag", 5, 1)], [("L1", 100)], noise, comp_level=2))
    speed = encode.encode(encode.Survey([("mag", 5, 1)], [("L1", 100)], {(0, 0): np.arange(300.0)}, comp_level=1))
    chunk = speed.index(encode.CHUNK_MAGIC)
    made = {
        "bad magic": b"nothing of the kind" + whole[19:],
        "short header": whole[:110],
        "mid header": whole[: last_block(whole) + 20],
        "slack": whole + b"\1" * 7,
        "past end": whole[: last_block(whole) + 60],
        "no pages": patched(4, struct.pack("<i", 0), block=1),
        "no magic": patched(0, b"junk", block=3)[: last_block(whole) + page],
        "junk pages": encode.encode(plain(junk_pages=2)),
        "short data": patched(40, struct.pack("<i", 9000), block=3),
        "ragged array": encode.encode(encode.Survey([("a", 5, 3)], [("L1", 100)], {(0, 0): np.arange(8.0)})),
        "unknown type": whole.replace(b"mag" + b"\0" * 73 + struct.pack("<h", 5), b"mag" + b"\0" * 73 + struct.pack("<h", 11)),
        "cut zlib": zipped[: zipped.index(encode.CHUNK_MAGIC) + 6000],
        "bad zlib": packed.replace(packed[packed.index(encode.CHUNK_MAGIC) + 16 : packed.index(encode.CHUNK_MAGIC) + 26], b"\xff" * 10),
        "bad lzrw1": speed[: chunk + 24] + b"\1\2\3\4" + speed[chunk + 28 :],
        "unknown subtype": speed[: chunk + 8] + struct.pack("<i", 5) + speed[chunk + 12 :],
    }
    return {name: written(spark, sf_dir, f"broken/{name.replace(' ', '-')}.survey", lambda data=data: data) for name, data in made.items()}
