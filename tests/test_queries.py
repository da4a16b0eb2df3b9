"""Every registered query against its SQL on the plain tables."""

import math
import os

import pytest

from surveyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else int(v) if not isinstance(v, (str, bool, bytes)) and hasattr(v, "__int__") else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(v) for v in r) for r in found.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() == 5


def made_orders(tmp_path, rows_of: dict[str, int]) -> str:
    import duckdb

    parts = " union all ".join(f"select '{p}' as p, * exclude (k) from (select *, k from '{SF}/orders.parquet', range(20) t(k) limit {n})" for p, n in rows_of.items())
    path = tmp_path / "orders.parquet"
    duckdb.execute(f"copy (select o_custkey, o_orderstatus, o_totalprice, o_orderdate, p as o_orderpriority, row_number() over () as o_orderkey from ({parts})) to '{path}' (format parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("rows_of", [{"a": 2046, "b": 10, "c": 2047}, {"a": 17000}, {"a": 16368}])
def test_chunks_of_blocks_that_are_just_one_chunk_or_more(spark, tmp_path, rows_of):
    """A block of exactly one full chunk counts; without blocks of one chunk there is still a row."""
    import duckdb

    folder = made_orders(tmp_path, rows_of)
    got = [tuple(r) for r in catalogue.QUERIES["catalog_chunks"](spark, folder).select("kind", "decompressed").collect()]
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{folder}/orders.parquet'")
    assert got == c.execute(catalogue.ORACLE_SQL["catalog_chunks"]).fetchall()


def test_surveys_of_orders_are_written_by_line(spark, tmp_path, monkeypatch):
    """The driver never holds all orders."""
    held = []
    whole = type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda df: (held.append(t := whole(df)), t)[1])
    folder = made_orders(tmp_path, {"a": 300, "b": 200, "c": 250})
    assert catalogue.QUERIES["scan_lzrw1"](spark, folder).count() == 750
    assert max(t.num_rows for t in held) == 300
