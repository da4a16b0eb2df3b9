"""The registered queries over surveys and over plain tables, and their SQL twins.

First come queries through the bytes: a table is written as a survey or grid file once, and read by the sources. Then the
operators on plain tables, which know nothing of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import sources
from surveyloom.api import Survey
from surveyloom.functions import cells as C
from surveyloom.functions import expressions as E
from surveyloom.functions.layout import PACKED_HEADER
from surveyloom.operators import alignment as A
from surveyloom.operators import registry as R
from surveyloom.operators import versions as V
from surveyloom.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Registers a query, and its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            sources.register(spark)
            return f(spark, sf_dir)

        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def load(spark: SparkSession, path: str, source: str = "survey", **options) -> DataFrame:
    return spark.read.format(source).options(**options).load(path)


# Scans of a survey of all orders, a line for each priority.

_FID = "cast(row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as integer)"
_WIDE = f"""select o_orderpriority as line, 'NORMAL' as line_category, {_FID} as fid, o_orderkey as order_key, o_custkey as cust_key,
o_orderstatus as status, o_totalprice as total_price, epoch_us(o_orderdate) as order_us from orders"""
_COLUMNS = ["line", "line_category", "fid", "order_key", "cust_key", "status", "total_price", "order_us"]

for _name, _options in {
    "scan_wide": {}, "scan_zlib": {"comp_level": 2}, "scan_lzrw1": {"comp_level": 1}, "scan_lzrw1_copies": {"comp_level": 1, "speed": "copies"}, "scan_stored_raw": {"comp_level": 1, "speed": "stored"}, "scan_bare": {"comp_level": 1, "speed": "bare"},
    "scan_calibrated": {"line_table": "shifted", "directory": False}, "scan_junk_pages": {"junk_pages": 3},
}.items():
    query(_WIDE, _name)(lambda spark, sf, _n=_name, _o=_options: load(spark, X.orders_survey(spark, sf, _n, **_o)).select(*_COLUMNS))


@query(_WIDE + " where o_orderpriority in ('1-URGENT', '5-LOW')")
def scan_filter_line(spark, sf):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wide = load(spark, X.orders_survey(spark, sf, "scan_wide"), pushdown="true")
    return wide.where(F.col("line").isin("1-URGENT", "5-LOW")).select(*_COLUMNS)


@query(f"select o_orderpriority as line, {_FID} as fid, o_totalprice as total_price from orders")
def scan_project(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "scan_wide"), channels="total_price").select("line", "fid", "total_price")


_PER_LINE = """select o_orderpriority as line, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as cents, min(o_totalprice) as least, max(o_totalprice) as largest
from orders group by 1"""


def _per_line(wide: DataFrame) -> DataFrame:
    cents = F.sum(F.round(F.col("total_price") * 100).cast("long"))
    return wide.groupBy("line").agg(F.count(F.lit(1)).alias("n"), cents.alias("cents"), F.min("total_price").alias("least"), F.max("total_price").alias("largest"))


@query(_PER_LINE)
def scan_agg_line(spark, sf):
    return _per_line(load(spark, X.orders_survey(spark, sf, "scan_wide"), channels="total_price"))


@query(_PER_LINE)
def scan_agg_zlib(spark, sf):
    return _per_line(load(spark, X.orders_survey(spark, sf, "scan_zlib", comp_level=2), channels="total_price"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["scan_agg_line"](spark, sf)


@query("""select o_orderstatus as line, cast(row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as integer) as fid, o_orderkey as order_key,
case when o_orderstatus = 'O' then o_custkey end as cust_key from orders""")
def scan_sparse(spark, sf):
    return load(spark, X.sparse_survey(spark, sf)).select("line", "fid", "order_key", "cust_key")


@query(f"""select line, fid, order_key, case when fid < n - 1 then total_price end as total_price from
(select o_orderpriority as line, {_FID} as fid, o_orderkey as order_key, o_totalprice as total_price, count(*) over (partition by o_orderpriority) as n from orders)""")
def scan_short_channel(spark, sf):
    def edit(s):
        s.cells = {k: v[:-1] if k[1] == 3 else v for k, v in s.cells.items()}

    return load(spark, X.orders_survey(spark, sf, "short", edit)).select("line", "fid", "order_key", "total_price")


@query("""select 'E' || label as line, cast(row_number() over (partition by label order by vec_id) - 1 as integer) as fid, vec_id,
cast(embedding[1] as double) as e0, cast(embedding[64] as double) as e63, cast(len(embedding) as integer) as width from embeddings""")
def scan_array(spark, sf):
    wide = load(spark, X.embeddings_survey(spark, sf))
    at = lambda i: F.get("embedding", i).cast("double").alias(f"e{i}")
    return wide.select("line", "fid", "vec_id", at(0), at(63), F.size("embedding").alias("width"))


_TYPES = {
    0: ("-128", "127", "-127"), 1: ("0", "65535", "65535"), 2: ("-32768", "32767", "-32767"), 3: ("-2147483648", "2147483647", "-2147483647"), 4: ("-0.5", "0.5", "-1e32"), 5: ("-0.5", "0.5", "-1e32"),
    6: ("0", "255", "255"), 7: ("0", "4294967295", "4294967295"), 8: ("-9223372036854775808", "9223372036854775807", "-9223372036854775808"), 9: ("0", "18446744073709551615", "18446744073709551615"),
}
_SQL_TYPES = {0: "tinyint", 1: "integer", 2: "smallint", 3: "integer", 4: "float", 5: "double", 6: "smallint", 7: "bigint", 8: "bigint", 9: "decimal(20,0)"}


def _types_sql(blank: bool) -> str:
    rows = []
    for fid in range(4):
        values = [v[fid] if fid < 3 else "1" for v in _TYPES.values()]
        blanks = [blank and v == d[2] for v, d in zip(values, _TYPES.values(), strict=True)]
        cells = ", ".join("null" if b else f"cast('{v}' as {_SQL_TYPES[i]})" for i, (v, b) in enumerate(zip(values, blanks, strict=True)))
        rows.append(f"select cast({fid} as integer), {cells}")
    return f"select * from ({' union all '.join(rows)}) t(fid, {', '.join(f't{i}' for i in range(10))})"


@query(_types_sql(False))
def scan_types(spark, sf):
    return load(spark, X.types_survey(spark, sf)).select("fid", *[f"t{i}" for i in range(10)])


@query(_types_sql(True))
def scan_types_dummy_as_null(spark, sf):
    return load(spark, X.types_survey(spark, sf), dummyAsNull="true").select("fid", *[f"t{i}" for i in range(10)])


def _with_dummies(s) -> None:
    s.cells = {k: [-1e32 if c % 7 == 0 else p for p, c in zip(v, s.cells[k[0], 1], strict=True)] if k[1] == 3 else v for k, v in s.cells.items()}


@query(f"select o_orderpriority as line, {_FID} as fid, nullif(case when o_custkey % 7 = 0 then -1e32 else o_totalprice end, -1e32) as total_price from orders")
def scan_dummy_as_null(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "dummies", _with_dummies), dummyAsNull="true", channels="total_price").select("line", "fid", "total_price")


# Live versions.


def _versions(s) -> None:
    s.stale = {k: -v for k, v in s.cells.items() if k[1] == 3}


def _unlisted(s) -> None:
    s.unlisted = {(1, 3), (2, 3)}


def _invalid(s) -> None:
    _versions(s)
    s.invalid = {(0, 3): "page", (1, 3): "pages", (2, 3): "flag", (3, 3): "index"}


_PRICE = f"select o_orderpriority as line, {_FID} as fid, {{}} as total_price from orders"
_UNLISTED = _PRICE.format("case when o_orderpriority in ('2-HIGH', '3-MEDIUM') then null else o_totalprice end")


def _price(spark, sf, name, edit, include="false", **options) -> DataFrame:
    return load(spark, X.orders_survey(spark, sf, name, edit, **options), includeUnlisted=include).select("line", "fid", "total_price")


query(_PRICE.format("o_totalprice"), "scan_live")(lambda spark, sf: _price(spark, sf, "live", _versions, stale_after=True))
query(_PRICE.format("-o_totalprice"), "scan_no_directory")(lambda spark, sf: _price(spark, sf, "no-directory", _versions, stale_after=True, directory=False))
query(_UNLISTED, "scan_unlisted")(lambda spark, sf: _price(spark, sf, "unlisted", _unlisted))
query(_PRICE.format("o_totalprice"), "scan_include_unlisted")(lambda spark, sf: _price(spark, sf, "unlisted", _unlisted, include="true"))
query(_PRICE.format("o_totalprice"), "scan_dir_invalid")(lambda spark, sf: _price(spark, sf, "invalid", _invalid))


@query(f"select o_orderpriority as line, {_FID} as fid, o_totalprice as value from orders where o_orderpriority = '3-MEDIUM'")
def read_cell(spark, sf):
    found = Survey(spark, X.orders_survey(spark, sf, "scan_zlib", comp_level=2)).read("3-MEDIUM", "total_price")
    return found.select(F.lit("3-MEDIUM").alias("line"), "fid", "value")


@query(f"""select line, c.channel, case c.channel when 'order_key' then order_key when 'cust_key' then cust_key else order_us end as value, fid
from ({_WIDE}), (values ('order_key'), ('cust_key'), ('order_us')) c(channel)""")
def cells_long(spark, sf):
    cells = load(spark, X.orders_survey(spark, sf, "scan_wide"), "survey_cells", channels="order_key,cust_key,order_us")
    return cells.select("line", "channel", F.posexplode("i").alias("fid", "value"))


# What a file says about itself.


@query("""select 'NONE' as compression_name, true as magic_ok, true as signature_common, cast(6 as integer) as chans_max, cast(3 as integer) as blobs_max, cast(6 as integer) as lines_max, cast(1 as integer) as users_max,
cast(39 as integer) as index_slots, cast(36 as integer) as data_slots, cast(1024 as integer) as page_size, cast(0 as integer) as comp_level""")
def catalog_headers(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "scan_wide"), "survey_catalog", table="headers").drop("path", "file_size")


@query("""select cast(s as integer) as channel_slot, n as name, t as type_name, cast(w as integer) as string_width from (values
(0, 'order_key', 'GS_LONG64', null), (1, 'cust_key', 'GS_LONG64', null), (2, 'status', 'string[1]', 1), (3, 'total_price', 'GS_DOUBLE', null), (4, 'order_us', 'GS_LONG64', null)) v(s, n, t, w)""")
def catalog_channels(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "scan_wide"), "survey_catalog", table="channels").select("channel_slot", "name", "type_name", "string_width")


@query("select cast(dense_rank() over (order by o_orderpriority) - 1 as integer) as line_slot, o_orderpriority as name, 'NORMAL' as category_name, true as exact from (select distinct o_orderpriority from orders)")
def catalog_lines(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "scan_wide"), "survey_catalog", table="lines").select("line_slot", "name", "category_name", "exact")


@query("""select o_orderpriority as line, c.channel, cast(count(*) as integer) as row_count from orders, (values ('order_key'), ('cust_key'), ('status'), ('total_price'), ('order_us')) c(channel) group by all""")
def cells_on_line(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "scan_wide"), "survey_catalog", table="live_blobs").select("line", "channel", "row_count")


@query("""select cast(l * 6 + c as integer) as blob_index, cast(case c when 3 then 2 else 1 end as bigint) as copies, 'live' as status, true as agrees from range(5) a(l), range(5) b(c)""")
def catalog_resolve(spark, sf):
    """The live copy by joins over the catalog's tables; the planner's own choice agrees."""
    path = X.orders_survey(spark, sf, "live", _versions, stale_after=True)
    head = load(spark, path, "survey_catalog", table="headers").first()
    blobs = load(spark, path, "survey_catalog", table="blobs")
    start = blobs.agg(F.min("offset")).first()[0]
    found = V.resolve(blobs, load(spark, path, "survey_catalog", table="directory"), head["data_slots"], start, head["page_size"])
    live = load(spark, path, "survey_catalog", table="live_blobs")
    live = live.select((F.col("line_slot") * head["chans_max"] + F.col("channel_slot")).alias("blob_index"), F.col("offset").alias("chosen"))
    return found.join(live, "blob_index").select("blob_index", "copies", "status", (F.col("offset") == F.col("chosen")).alias("agrees"))


@query("""select code, line, channel from (values
('DIRECTORY_INVALID', '1-URGENT', 'total_price'), ('DIRECTORY_INVALID', '2-HIGH', 'total_price'), ('DIRECTORY_INVALID', '3-MEDIUM', 'total_price'), ('DIRECTORY_INVALID', '4-NOT SPECIFIED', 'total_price')) v(code, line, channel)""")
def diagnostics_directory(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "invalid", _invalid), "survey_catalog", table="diagnostics").select("code", "line", "channel")


@query("select o_orderpriority as line, 'SHORT_CHANNEL' as code, 'total_price' as channel from (select distinct o_orderpriority from orders)")
def diagnostics_validate(spark, sf):
    QUERIES["scan_short_channel"](spark, sf)
    path = X.orders_survey(spark, sf, "short")
    return load(spark, path, "survey_catalog", table="diagnostics", validate="true").select("line", "code", "channel")


@query("""select * from (values ('header', '16', '9'), ('channel', '108', '6'), ('users', 'in use', '2'), ('line', 'type', '3'), ('line', '104', '00c59df414e384bcd6bf91c6176e05b5b5b89346'),
('projection', 'slot 7', '4.0'), ('projection', 'method', '77'), ('extensions', 'payload size', '84'), ('creation', 'flag', '7')) v(record, field, value)""")
def conformance(spark, sf):
    """What no conforming file holds, of a file with one such thing of each kind; a clean file beside it adds nothing."""
    paths = ",".join([X.odd_survey(spark, sf), X.orders_survey(spark, sf, "scan_wide")])
    return load(spark, paths, "survey_catalog", table="conformance").select("record", "field", "value")


_BROKEN = """('bad magic', 'BAD_MAGIC', 1), ('short header', 'HEADER_TRUNCATED', 1), ('short header', 'CHANNEL_TABLE_NOT_FOUND', 1), ('short header', 'LINE_TABLE_NOT_FOUND', 1), ('mid header', 'MID_HEADER', 1), ('slack', 'SLACK', 1), ('past end', 'PAST_EOF', 1), ('past end', 'SHORT_DATA', 1),
('no pages', 'BAD_NPAGES', 1), ('no magic', 'MAGIC_MISMATCH', 1), ('junk pages', 'PAGES_SKIPPED', 1), ('short data', 'SHORT_DATA', 1), ('ragged array', 'RAGGED_ARRAY', 1),
('unknown type', 'UNKNOWN_TYPE', 2), ('cut zlib', 'PAST_EOF', 1), ('cut zlib', 'SHORT_COMPRESSED', 1), ('cut zlib', 'ZLIB_FAIL', 1), ('bad zlib', 'ZLIB_FAIL', 2), ('bad lzrw1', 'LZRW1_FAIL', 1), ('unknown subtype', 'UNKNOWN_SUBTYPE', 1)"""


@query(f"select file, code, cast(n as bigint) as n from (values {_BROKEN}) v(file, code, n)")
def diagnostics_broken(spark, sf):
    """Each kind of damage to headers, chain and blocks has its code; what follows from it is left out."""
    paths = X.broken_surveys(spark, sf)
    found = load(spark, ",".join(paths.values()), "survey_catalog", table="diagnostics", validate="true").where("code <> 'SHORT_CHANNEL'")
    name = F.regexp_replace(F.regexp_extract("path", "broken/([^/]*)[.]survey$", 1), "-", " ")
    return found.groupBy(name.alias("file"), "code").agg(F.count(F.lit(1)).alias("n"))


@query("""select * from (values ('REG_CONFLICT', 'raw_mag'), ('IPJ_TEXT_MISMATCH', null)) v(code, channel)""")
def diagnostics_registry(spark, sf):
    return Survey(spark, X.registry_survey(spark, sf)).diagnostics().where("code like 'REG%' or code like 'IPJ%' or code like 'MAKER%' or code like 'ROLE%'").select("code", "channel")


@query("""with l as (select o_orderpriority as line, row_number() over (order by o_orderpriority) - 1 as slot, count(*) as n from orders group by 1)
select cast(l.slot * 6 + c.pos as integer) as blob_index, cast(l.slot as integer) as line_slot, cast(c.pos as integer) as channel_slot, cast(n as integer) as row_count, c.code as gs_type_code, false as is_packed
from l, (values (0, 8), (1, 8), (2, -1), (3, 5), (4, 8)) c(pos, code)""")
def catalog_blobs(spark, sf):
    return load(spark, X.orders_survey(spark, sf, "scan_wide"), "survey_catalog", table="blobs").select("blob_index", "line_slot", "channel_slot", "row_count", "gs_type_code", "is_packed")


@query("""select cast(slot as integer) as symbol_slot, name from (values (3, 'roles'), (4, 'crs'), (5, 'crs2'), (6, 'text'), (7, 'bad text'), (9, 'Display List'), (10, 'Other')) v(slot, name)""")
def catalog_symbols(spark, sf):
    return load(spark, X.registry_survey(spark, sf), "survey_catalog", table="symbols").where("name not like '\\\\_\\\\_%'").select("symbol_slot", "name")


@query("""select * from (values ('REG', cast(8 as bigint)), ('IPJ', cast(2 as bigint)), ('', cast(1 as bigint))) v(tag, n)""")
def catalog_admin_objects(spark, sf):
    return load(spark, X.registry_survey(spark, sf), "survey_catalog", table="admin_objects").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""with n as (select o_orderpriority as line, count(*) as n from orders group by 1)
select 'stored' as kind, cast(sum(case when n * w % 16368 = 0 then 16368 else n * w % 16368 end) as bigint) as decompressed from n, (values (8), (8), (1), (8), (8)) c(w) where n * w <= 16368""")
def catalog_chunks(spark, sf):
    """First chunks of blocks that have one chunk only; a row even if there are none."""
    path = X.orders_survey(spark, sf, "scan_stored_raw", comp_level=1, speed="stored")
    blobs = load(spark, path, "survey_catalog", table="blobs")
    single = blobs.where("packed_length <= 16368").select((F.col("offset") + PACKED_HEADER).alias("offset"))
    found = load(spark, path, "survey_catalog", table="chunks").where("kind = 'stored'").join(single, "offset", "left_semi")
    return found.agg(F.lit("stored").alias("kind"), F.sum("decompressed_length").alias("decompressed"))


@query("""select line, line_category, cast(fid as integer) as fid, mag, mag1, mag2, cast(cl as integer) as channel_line, cast(cf as integer) as channel_fid from (values
('L1', 'NORMAL', 0, 0.0::double, 1.0::double, 2.0::double, 3, 4), ('L1', 'NORMAL', 1, 10.0::double, 11.0::double, 12.0::double, 13, 14),
('L2', 'GROUP', 0, null, 100.0::double, null, null, null), ('L2', 'GROUP', 1, null, 101.0::double, null, null, null), ('L2', 'GROUP', 2, null, 102.0::double, null, null, null)) v(line, line_category, fid, mag, mag1, mag2, cl, cf)""")
def names_wide(spark, sf):
    wide = load(spark, X.names_survey(spark, sf))
    return wide.select("line", "line_category", "fid", "mag", F.col("`mag[1]`").alias("mag1"), F.col("`Mag[2]`").alias("mag2"), "channel_line", F.col("channel_FID").alias("channel_fid"))


@query("""select cast(grid_row as integer) as grid_row, cast(grid_col as integer) as grid_col, coalesce(n, 0)::double as value from
(select n_nationkey as grid_row, s.grid_col, (select count(*) from customer where c_nationkey = n_nationkey and c_mktsegment = s.seg) as n from nation,
(select row_number() over (order by seg) - 1 as grid_col, seg from (select distinct c_mktsegment as seg from customer)) s)""")
def grid_scan(spark, sf):
    return load(spark, X.nation_grid(spark, sf, False), "survey_grid").select("grid_row", "grid_col", "value")


query(ORACLE_SQL["grid_scan"], "grid_scan_packed")(lambda spark, sf: load(spark, X.nation_grid(spark, sf, True), "survey_grid").select("grid_row", "grid_col", "value"))


@query("""select cast(grid_row as integer) as grid_row, cast(sum(n) as double) as total, 200.0::double + grid_row as y from
(select c_nationkey as grid_row, count(*) as n from customer group by 1) group by 1, 3""")
def grid_sum(spark, sf):
    cells = load(spark, X.nation_grid(spark, sf, True), "survey_grid", coordinates="true")
    return cells.groupBy("grid_row", "y").agg(F.sum("value").alias("total")).where("total > 0")


@query("select true as is_compressed, cast(5 as integer) as shape_e, cast(25 as integer) as shape_v, cast(8 as integer) as element_size, -1e32::double as dummy")
def grid_headers(spark, sf):
    return load(spark, X.nation_grid(spark, sf, True), "survey_grid_headers", validate="true").where(F.size("diagnostics") == 0).select("is_compressed", "shape_e", "shape_v", "element_size", "dummy")


# The registry of a file.


@query("select * from (values ('raw_mag', 'UNITS', 'nT', true), ('raw_mag', 'LABEL', 'Raw magnetics', false), ('Easting', 'UNITS', 'm', false)) v(channel, key, value, conflict)")
def registry_settings(spark, sf):
    return Survey(spark, X.registry_survey(spark, sf)).channel_settings().select("channel", "key", "value", "conflict")


@query("select * from (values ('X', 'Easting', false), ('Y', 'Northing', false), ('Z', null, false)) v(role, channel, ambiguous)")
def registry_roles(spark, sf):
    return Survey(spark, X.registry_survey(spark, sf)).coordinate_channels().select("role", "channel", "ambiguous")


@query("select cast(pos as integer) as pos, name from (values (0, 'WGS 84 / UTM zone 54S'), (1, 'Amersfoort / RD New')) v(pos, name)")
def registry_crs(spark, sf):
    return Survey(spark, X.registry_survey(spark, sf)).coordinate_systems().select(F.col("pos").cast("int").alias("pos"), "name")


@query("""select name, method, parameter_source, text_mismatch, parameter, value::double as value from (values
('WGS 84 / UTM zone 54S', 'Transverse Mercator', 'binary', true, 'latitude_of_natural_origin', 0.0), ('WGS 84 / UTM zone 54S', 'Transverse Mercator', 'binary', true, 'longitude_of_natural_origin', 141.0),
('WGS 84 / UTM zone 54S', 'Transverse Mercator', 'binary', true, 'scale_factor_at_natural_origin', 0.9996), ('WGS 84 / UTM zone 54S', 'Transverse Mercator', 'binary', true, 'false_easting', 500000.0),
('WGS 84 / UTM zone 54S', 'Transverse Mercator', 'binary', true, 'false_northing', 10000000.0),
('Amersfoort / RD New', 'Oblique Stereographic', 'text', false, 'latitude_of_natural_origin', 52.15616055555555), ('Amersfoort / RD New', 'Oblique Stereographic', 'text', false, 'longitude_of_natural_origin', 5.38763888888889),
('Amersfoort / RD New', 'Oblique Stereographic', 'text', false, 'scale_factor_at_natural_origin', 0.9999079), ('Amersfoort / RD New', 'Oblique Stereographic', 'text', false, 'false_easting', 155000.0),
('Amersfoort / RD New', 'Oblique Stereographic', 'text', false, 'false_northing', 463000.0)) v(name, method, parameter_source, text_mismatch, parameter, value)""")
def registry_projection(spark, sf):
    found = Survey(spark, X.registry_survey(spark, sf)).projection_parameters()
    rows = found.select("name", "method", "parameter_source", "text_mismatch", F.explode("method_parameters").alias("p"))
    return rows.select("name", "method", "parameter_source", "text_mismatch", F.col("p.name").alias("parameter"), F.col("p.value").alias("value"))


@query("select 'raw_mag' as channel, 'newchan.gx' as tool, 'New channel' as label, k, v from (values ('CHANNEL', 'raw_mag'), ('EXPR', 'a=b')) t(k, v)")
def registry_makers(spark, sf):
    found = Survey(spark, X.registry_survey(spark, sf)).channel_makers()
    return found.select("channel", "tool", "label", F.explode("params").alias("p")).select("channel", "tool", "label", "p.k", "p.v")


@query("select cast(pos as integer) as pos, label, channel from (values (0, 'raw_mag', 'raw_mag'), (1, 'lost', null)) v(pos, label, channel)")
def registry_display(spark, sf):
    return Survey(spark, X.registry_survey(spark, sf)).display_lists().select("pos", "label", "channel")


# Exports.


@query("""with o as (select o_orderstatus as line, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as fid, o_orderkey, case when o_orderstatus = 'O' then o_custkey end as cust from orders),
f as (select line, fid from (select distinct line from o), range((select max(fid) + 1 from o)) t(fid))
select f.line, cast(f.fid as integer) as fid, coalesce(o_orderkey, -9223372036854775808) as order_key, coalesce(cust, -9223372036854775808) as cust_key from f left join o on f.line = o.line and f.fid = o.fid""")
def densify(spark, sf):
    return Survey(spark, X.sparse_survey(spark, sf)).dense().drop("line_slot", "line_category")


_DUMMY = "-1e32::double"


@query(f"""select cast(slot as integer) as line_slot, line, cast(fid as integer) as fid, mag, d0, d2 from (values
(0, 'L1', 0, 1.0::double, 0.0::double, 2.0::double), (0, 'L1', 1, 2.0, 3.0, 5.0), (0, 'L1', 2, {_DUMMY}, {_DUMMY}, {_DUMMY}),
(1, 'L1', 0, 5.0, {_DUMMY}, {_DUMMY}), (1, 'L1', 1, 6.0, {_DUMMY}, {_DUMMY}), (1, 'L1', 2, 7.0, {_DUMMY}, {_DUMMY}),
(2, 'L2', 0, 9.0, {_DUMMY}, {_DUMMY}), (2, 'L2', 1, {_DUMMY}, {_DUMMY}, {_DUMMY}), (2, 'L2', 2, {_DUMMY}, {_DUMMY}, {_DUMMY})) v(slot, line, fid, mag, d0, d2)""")
def densify_repeated(spark, sf):
    """Two lines of one name stay two, and array channels are filled too."""
    wide = Survey(spark, X.repeated_survey(spark, sf)).dense()
    return wide.select("line_slot", "line", "fid", "mag", F.col("depths")[0].alias("d0"), F.col("depths")[2].alias("d2"))


@query("""select line, cast(fid as integer) as fid, x, y, z, mag from (values ('L0', 0, 0.0::double, 100.0::double, 200.0::double, 300.0::double), ('L0', 1, 1.0, 101.0, 201.0, 301.0),
('L2', 0, 20.0, 120.0, 0.0, 320.0), ('L2', 1, 21.0, 121.0, 0.0, 321.0), ('L3', 0, 30.0, 130.0, 0.0, 330.0), ('L3', 1, 31.0, 131.0, 0.0, null)) v(line, fid, x, y, z, mag)""")
def points_by_line(spark, sf):
    """A line of unequal coordinates isn't placed; heights of another length are 0."""
    return Survey(spark, X.places_survey(spark, sf)).points(z="alt").select("line", "fid", "x", "y", "z", "mag")


@query("""select o_orderpriority as line, 'total_price' as channel, count(*) as row_count, cast(0 as bigint) as timestamp_raw from orders where o_orderpriority = '2-HIGH' group by 1""")
def block_lookup(spark, sf):
    """The first copy of one cell's block."""
    s = Survey(spark, X.orders_survey(spark, sf, "scan_wide"))
    return s.block("2-HIGH", "total_price").select(F.lit("2-HIGH").alias("line"), F.lit("total_price").alias("channel"), F.col("row_count").cast("long").alias("row_count"), F.col("timestamp_raw").cast("long").alias("timestamp_raw"))


@query("select 'cust_key' as channel, o_orderstatus as line from (select distinct o_orderstatus from orders) where o_orderstatus <> 'O'")
def absent_cells(spark, sf):
    return Survey(spark, X.sparse_survey(spark, sf)).absent_cells().select("channel", "line")


@query("""with n as (select o_orderpriority as line, count(*) as n, max(length(o_orderstatus)) as w from orders group by 1)
select channel, cast(count(*) as bigint) as lines, cast(max(n) as integer) as most_rows, cast(max(case when channel = 'status' then w else 0 end) as integer) as widest
from n, (values ('order_key'), ('cust_key'), ('status'), ('total_price'), ('order_us')) c(channel) group by 1""")
def channel_extents(spark, sf):
    return Survey(spark, X.orders_survey(spark, sf, "scan_wide")).extents().select("channel", "lines", "most_rows", F.coalesce("widest", F.lit(0)).alias("widest"))


@query("select 'total_price' as channel, count(distinct o_orderpriority) as skipped from orders where o_orderpriority in ('2-HIGH', '3-MEDIUM')")
def skipped_blocks(spark, sf):
    """Cells that the directory doesn't list, by channel."""
    return Survey(spark, X.orders_survey(spark, sf, "unlisted", _unlisted)).skipped().select("channel", "skipped")


@query(f"select o_orderpriority as line, {_FID} as fid, cast(o_custkey as double) as x, o_totalprice as y, 0.0::double as z, o_orderkey as order_key from orders")
def points(spark, sf):
    return Survey(spark, X.orders_survey(spark, sf, "scan_wide")).points(x="cust_key", y="total_price").select("line", "fid", "x", "y", "z", "order_key")


@query("""select 'E' || label as line, vec_id, cast(embedding[2] as double) as e1, cast(embedding[10] as double) as e9 from embeddings""")
def flatten_array(spark, sf):
    flat = Survey(spark, X.embeddings_survey(spark, sf)).flattened()
    return flat.select("line", "vec_id", F.col("`embedding[1]`").cast("double").alias("e1"), F.col("`embedding[9]`").cast("double").alias("e9"))


@query(_PER_LINE)
def file_arrival_stream(spark, sf):
    """The same rows by a stream over the folder that the file is in."""
    import uuid

    from surveyloom import streaming

    path = X.orders_survey(spark, sf, "arrival/orders", comp_level=2)
    schema = load(spark, path).schema
    stream = streaming.arriving(spark, path.rpartition("/")[0], schema)
    out, marks = (f"{X.folder(spark)}/{k}-{uuid.uuid4().hex}" for k in ("stream", "marks"))
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    job.awaitTermination()
    return _per_line(spark.read.schema(schema).parquet(out))


# Operators on plain tables.

table = X.table


@query("""select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id, count(*) as copies from events group by 1, 2""")
def latest_copy(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return V.latest(rows, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "event_id", "copies")


_BLOBS = "select o_custkey as blob_index, cast(1000 + o_orderkey * 10 as bigint) as \"offset\", cast(o_orderkey % 4 + 1 as integer) as n_pages, o_orderkey as chain_pos from orders"
_DIRECTORY = """select blob_index as slot, case blob_index % 5 when 0 then 2147483648 + lo when 1 then lo when 2 then 2147483648 + lo + 1 else 2147483648 + hi end as word,
case blob_index % 5 when 3 then pages + 1 else pages end as n_pages from (select blob_index, min(chain_pos) as lo, max(chain_pos) as hi, arg_min(n_pages, case when blob_index % 5 = 0 then chain_pos else -chain_pos end) as pages from b group by 1) where blob_index % 6 <> 0"""


@query(f"""with b as ({_BLOBS}), d as ({_DIRECTORY}), c as (select blob_index, count(*) as copies, arg_max("offset", chain_pos) as last_offset from b group by 1),
j as (select c.*, d.word, t."offset" as target from c left join d on d.slot = c.blob_index left join (select distinct blob_index, "offset", n_pages from b) t
 on t.blob_index = c.blob_index and d.word >= 2147483648 and t."offset" = 1000 + (d.word & 1073741823) * 10 and t.n_pages = d.n_pages)
select blob_index, copies, case when blob_index >= (select cast(max(blob_index) * 0.9 as bigint) from b) then 'outside' when word is null then 'absent' when target is not null then 'live' else 'invalid' end as status,
case when blob_index >= (select cast(max(blob_index) * 0.9 as bigint) from b) then last_offset when word is null then null when target is not null then target else last_offset end as "offset" from j""")
def directory_resolve(spark, sf):
    blobs = table(spark, sf, "orders").select(F.col("o_custkey").alias("blob_index"), (1000 + F.col("o_orderkey") * 10).alias("offset"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("n_pages"), F.col("o_orderkey").alias("chain_pos"))
    kind = F.col("blob_index") % 5
    best = F.min_by("n_pages", F.when(kind == 0, F.col("chain_pos")).otherwise(-F.col("chain_pos")))
    slots = blobs.groupBy("blob_index").agg(F.min("chain_pos").alias("lo"), F.max("chain_pos").alias("hi"), best.alias("pages")).where("blob_index % 6 <> 0")
    live = F.lit(2147483648)
    word = F.when(kind == 0, live + F.col("lo")).when(kind == 1, F.col("lo")).when(kind == 2, live + F.col("lo") + 1).otherwise(live + F.col("hi"))
    directory = slots.select(F.col("blob_index").alias("slot"), word.alias("word"), F.when(kind == 3, F.col("pages") + 1).otherwise(F.col("pages")).alias("n_pages"))
    data_slots = int(blobs.agg(F.max("blob_index")).first()[0] * 0.9 + 0.5)
    return V.resolve(blobs, directory, data_slots, 1000, 10)


@query("select p_partkey, case when occ = 0 then p_name else p_name || '[' || occ || ']' end as var_name, cast(occ as integer) as occurrence, cast(n as integer) as siblings from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as occ, count(*) over (partition by p_name) as n from part)")
def occurrence_rename(spark, sf):
    return V.numbered(table(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "var_name", "occurrence", "siblings")


@query("select name, column_name from (values ('line', 'channel_line'), ('Line', 'channel_Line'), ('LINE_CATEGORY', 'channel_LINE_CATEGORY'), ('mag', 'mag'), ('fid2', 'fid2')) v(name, column_name)")
def reserved_rename(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("line", "Line", "LINE_CATEGORY", "mag", "fid2")], "name string")
    return V.renamed_reserved(names, "name", ("path", "line", "line_category", "line_slot", "fid")).select("name", "column_name")


@query("select event_id, case when event_id % 10 > 0 then epoch_us(to_timestamp(1700000000 + event_id * 61)) else -1 end as at_us from events")
def raw_timestamps(spark, sf):
    """Seconds as blocks hold them, of which one value means none."""
    raw = F.when(F.col("event_id") % 10 > 0, 1700000000 + F.col("event_id") * 61).otherwise(-(2**31))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.unix_micros(E.timestamp(raw)), F.lit(-1)).alias("at_us"))


@query("select event_id, cast(floor((event_id - 500) / 7.0) as bigint) as line_slot, ((event_id - 500) % 7 + 7) % 7 as channel_slot from events")
def slot_divmod(spark, sf):
    index, chans = F.col("event_id") - 500, F.lit(7).cast("long")
    return table(spark, sf, "events").select("event_id", E.line_slot(index, chans).alias("line_slot"), E.channel_slot(index, chans).alias("channel_slot"))


_STATIONS = "select user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as integer) as fid, value from events where event_type = '{}'"


def _channel(spark, sf, kind: str, name: str) -> DataFrame:
    rows = table(spark, sf, "events").where(F.col("event_type") == kind)
    return A.stations(rows, ["user_id"], ["event_id"]).select("user_id", "fid", F.col("value").alias(name))


@query(f"select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.fid, b.fid) as fid, a.value as clicks, b.value as views from ({_STATIONS.format('click')}) a full join ({_STATIONS.format('view')}) b on a.user_id = b.user_id and a.fid = b.fid")
def pad_align(spark, sf):
    return A.align([_channel(spark, sf, "click", "clicks"), _channel(spark, sf, "view", "views")], ["user_id", "fid"])


@query(f"select user_id, fid, value as clicks, null::double as views from ({_STATIONS.format('click')}) union all select user_id, fid, null, value from ({_STATIONS.format('view')})")
def union_columns(spark, sf):
    return A.stack([_channel(spark, sf, "click", "clicks"), _channel(spark, sf, "view", "views")])


@query("select o_orderkey, v.channel, v.value from orders, lateral (values ('o_totalprice', o_totalprice), ('o_custkey', cast(o_custkey as double))) v(channel, value)")
def melt_cells(spark, sf):
    return A.long_form(table(spark, sf, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"])


_DENSE_SOURCE = "select user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as integer) as fid, value from events"


@query(f"""with s as ({_DENSE_SOURCE}), f as (select user_id, fid from (select distinct user_id from s), range((select max(fid) + 1 from s)) t(fid))
select f.user_id, cast(f.fid as integer) as fid, coalesce(s.value, -1e32) as value from f left join s on f.user_id = s.user_id and f.fid = s.fid""")
def densify_fill(spark, sf):
    return A.dense(A.stations(table(spark, sf, "events"), ["user_id"], ["event_id"]).select("user_id", "fid", "value"), "user_id", "fid", {"value": -1e32})


@query("""with e as (select user_id, event_type, strftime(ts, '%Y-%m-%d') as day from events)
select u.user_id, t.event_type, t.day from (select distinct user_id from e) u, (select distinct event_type, day from e) t
where not exists (select 1 from e where e.user_id = u.user_id and e.event_type = t.event_type and e.day = t.day)""")
def missing_cells(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return A.missing(rows.select("user_id").distinct(), rows.select("event_type", "day").distinct(), rows, ["user_id", "event_type", "day"])


@query("""with c as (select p_brand, p_type as t from part where p_size < 12), k as (select distinct p_type as t from part where p_retailprice > (select quantile_disc(p_retailprice, 0.9) from part)),
v as (select p_brand, min(t) as lo, max(t) as hi from c where t in (select t from k) group by 1)
select b.p_brand, case when lo = hi then lo end as p_type, coalesce(lo <> hi, false) as ambiguous from (select distinct p_brand from c) b left join v on b.p_brand = v.p_brand""")
def role_resolve(spark, sf):
    parts = table(spark, sf, "part")
    bar = parts.agg(F.expr("percentile_disc(0.9) within group (order by p_retailprice)")).first()[0]
    return V.one_or_none(parts.where("p_size < 12").select("p_brand", "p_type"), parts.where(F.col("p_retailprice") > bar).select("p_type"), "p_brand", "p_type")


@query("select user_id, event_type as key, arg_max(props, event_id) as value, min(props) <> max(props) as conflict from events group by 1, 2")
def kv_collapse(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), F.col("props").alias("value"), "event_id")
    return V.collapse(rows, ["user_id", "key"], "value", "event_id")


@query("""with e as (select distinct user_id, date_diff('hour', timestamp '2024-01-01', ts) as hour from events)
select user_id, min(hour) as first, count(*) as length from (select *, hour - row_number() over (partition by user_id order by hour) as island from e) group by user_id, island""")
def page_runs(spark, sf):
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return A.runs(table(spark, sf, "events").select("user_id", hour.alias("hour")), ["user_id"], "hour")


@query("select event_type, min(event_id) as first_pos from events group by 1")
def first_seen_distinct(spark, sf):
    return V.first_seen(table(spark, sf, "events"), "event_type", "event_id")


@query("select user_id, event_type, count(*) as copies from events group by 1, 2 having count(*) > 1")
def duplicate_pairs(spark, sf):
    return V.duplicates(table(spark, sf, "events"), ["user_id", "event_type"])


@query("""with s as (select 3 * s_suppkey as slot from supplier), h as (select distinct 3 * s_suppkey + 2 as slot from supplier),
k as (select cast(t.o - 4 as integer) as shift, (select count(*) from s where s.slot + t.o - 4 in (select slot from h)) as score from range(9) t(o))
select shift, score, row_number() over (order by score desc, abs(shift), shift desc) = 1 as chosen from k""")
def calibrate_offsets(spark, sf):
    slots = table(spark, sf, "supplier").select((3 * F.col("s_suppkey")).alias("slot"))
    return A.calibrate(slots, slots.select((F.col("slot") + 2).alias("slot")))


@query("select event_type, (select count(*) - 3 from (select distinct event_type from events)) as more from (select distinct event_type from events) order by event_type limit 3")
def top_n_more(spark, sf):
    return A.summary(table(spark, sf, "events").select("event_type").distinct(), "event_type", ["event_type"], 3)


_TEXTS = [("a", '"Transverse Mercator",0,141,0.9996,500000,10000000'), ("b", '"Geographic"'), ("c", "no quotes,1"), ("d", '"Mercator (1SP)", 1.5 ,x'), ("e", '"Geographic",  ')]


@query("""select * from (values ('a', 'Transverse Mercator', 5, 141.0::double), ('b', 'Geographic', 0, null), ('c', null, null, null), ('d', null, null, null), ('e', 'Geographic', 0, null)) v(id, method, n, second)""")
def gxf_text_parse(spark, sf):
    texts = spark.createDataFrame(_TEXTS, "id string, text string")
    method, values = E.projection_method(F.col("text")), E.projection_values(F.col("text"))
    n = F.when(values.isNotNull(), F.size(values))
    return texts.select("id", method.alias("method"), n.alias("n"), F.get(values, 1).alias("second"))


@query("select * from (values ('a', true), ('b', false), ('c', null), ('d', null), ('e', false)) v(id, fits)")
def gxf_text_match(spark, sf):
    slots = F.array(*[F.lit(v).cast("double") for v in (0.0, 141.0, None, None, 0.9996, 500000.0, 10000000.0, None)])
    return spark.createDataFrame(_TEXTS, "id string, text string").select("id", E.holds_in_order(E.projection_values(F.col("text")), slots).alias("fits"))


@query("select s_suppkey, round(degrees(s_acctbal / 1e6) * 3600, 6) as arc_seconds, round((1 + s_acctbal / 1e9 - 1) * 1e6, 6) as ppm from supplier")
def unit_convert(spark, sf):
    value = F.col("s_acctbal")
    return table(spark, sf, "supplier").select("s_suppkey", F.round(E.arc_seconds(value / 1e6), 6).alias("arc_seconds"), F.round(E.parts_per_million(1 + value / 1e9), 6).alias("ppm"))


_CODES = " ".join(f"when {k} then '{v}'" for k, v in C.FORMAT_NAMES.items())


@query(f"select l_linenumber as code, case l_linenumber {_CODES} else 'unknown(' || l_linenumber || ')' end as format_name, count(*) as n from lineitem group by 1")
def code_labels(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("code", E.label(F.col("code"), C.FORMAT_NAMES).alias("format_name"), "n")


@query("select vec_id, cast(r as integer) as row, cast(embedding[r * 8 + 3] as double) as third from embeddings, range(8) t(r)")
def array_rows(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(E.rows_of(F.col("embedding"), 8)).alias("row", "part"))
    return rows.select("vec_id", "row", F.get("part", 2).cast("double").alias("third"))
