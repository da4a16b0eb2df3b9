import numpy as np
import pytest
from helpers import basic, rows, write

from surveyloom import sources, streaming
from surveyloom.plans import encode
from surveyloom.sources.survey import common_type


@pytest.fixture(autouse=True)
def known(spark):
    sources.register(spark)


def load(spark, path, source="survey", **options):
    return spark.read.format(source).options(**options).load(path)


def test_lines_and_stations(spark, tmp_path):
    df = load(spark, write(tmp_path, basic()))
    assert df.columns == ["path", "line", "line_category", "line_slot", "fid", "Fiducial", "Easting", "Depths"]
    assert rows(df, "line", "line_category", "fid", "Fiducial", "Easting") == [("L100", "NORMAL", 0, 1, 10.0), ("L100", "NORMAL", 1, 2, 20.0), ("L100", "NORMAL", 2, 3, -1e32), ("L200", "GROUP", 0, 4, 30.0), ("L200", "GROUP", 1, 5, 40.0)]
    assert rows(df.where("line = 'L200'"), "Depths") == [(None,), (None,)]
    assert df.schema["Depths"].metadata["array_width"] == 3 and df.schema["Easting"].metadata["type_name"] == "GS_DOUBLE"


def test_options(spark, tmp_path):
    path = write(tmp_path, basic())
    assert load(spark, path, lines="L200").count() == 2
    assert load(spark, path, lines='["L100"]').count() == 3
    assert load(spark, path, channels="Easting").columns[-1] == "Easting"
    assert rows(load(spark, path, dummyAsNull="true", lines="L100"), "Easting") == [(10.0,), (20.0,), (None,)]
    pruned = spark.read.format("survey").schema("line string, Easting double").load(path)
    assert pruned.columns == ["line", "Easting"] and pruned.count() == 5


def test_filters_choose_partitions(spark, tmp_path):
    path = write(tmp_path, basic())
    assert load(spark, path, partitionBytes=1).rdd.getNumPartitions() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = load(spark, path, partitionBytes=1, pushdown="true")
        assert pushed.where("line = 'L200'").rdd.getNumPartitions() == 1
        assert rows(pushed.where("line = 'L200' and Easting > 35"), "Fiducial") == [(5,)]
        assert pushed.where("line_category in ('NORMAL') and line_slot = 0").count() == 3
        assert load(spark, path, "survey_catalog", table="lines", pushdown="true").where("path = 'x'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_directories(spark, tmp_path):
    write(tmp_path, basic(), "a.survey")
    other = encode.Survey([("Fiducial", 8, 1), ("New", -3, 1)], [("L9", 100)], {(0, 0): [7], (0, 1): ["abc"]})
    write(tmp_path, other, "b.survey")
    df = load(spark, str(tmp_path))
    assert dict(df.dtypes)["Fiducial"] == "bigint" and df.count() == 6
    assert rows(df.where("line = 'L9'"), "Fiducial", "Easting", "New") == [(7, None, "abc")]
    assert load(spark, str(tmp_path), filesAsPartitions=1).rdd.getNumPartitions() == 2
    assert load(spark, str(tmp_path), filesAsPartitions=1).count() == 6


def test_types_of_two_files():
    assert common_type("int", "long", "x") == "long" and common_type("float", "double", "x") == "double"
    assert common_type("array<int>", "array<float>", "x") == "array<double>"
    with pytest.raises(ValueError):
        common_type("int", "string", "x")
    with pytest.raises(ValueError):
        common_type("int", "array<int>", "x")


def test_cells_keep_their_length(spark, tmp_path):
    s = basic()
    s.cells[0, 1] = [1.0]
    path = write(tmp_path, s)
    assert rows(load(spark, path, "survey_cells"), "line", "channel", "n_rows") == [("L100", "Depths", 3), ("L100", "Easting", 1), ("L100", "Fiducial", 3), ("L200", "Easting", 2), ("L200", "Fiducial", 2)]
    assert rows(load(spark, path).where("line = 'L100'"), "Easting") == [(1.0,), (None,), (None,)]
    found = load(spark, path, "survey_catalog", table="diagnostics", validate="true")
    assert rows(found, "code", "channel") == [("SHORT_CHANNEL", "Easting")]


def test_every_catalog_table_reads(spark, tmp_path):
    from surveyloom.sources.catalog import TABLES

    path = write(tmp_path, basic(comp_level=1))
    for table in TABLES:
        load(spark, path, "survey_catalog", table=table).collect()
    assert load(spark, path, "survey_catalog", table="chunks").count() == 5
    assert load(spark, path, "survey_catalog", table="blobs", limit=2).count() == 2
    with pytest.raises(Exception, match="no catalog table"):
        load(spark, path, "survey_catalog", table="nothing").count()
    bad = write(tmp_path, b"no survey", "bad")
    assert load(spark, bad, "survey_catalog", table="headers").first()["magic_ok"] is False
    assert load(spark, bad).count() == 0


def test_conformance(spark, tmp_path):
    path = write(tmp_path, basic())
    assert load(spark, path, "survey_catalog", table="conformance").count() == 0
    data = bytearray(encode.encode(basic(users=2)))
    data[8:12] = b"\1\0\0\0"
    odd = load(spark, write(tmp_path, bytes(data), "odd"), "survey_catalog", table="conformance")
    assert rows(odd, "record", "field", "value")[:2] == [("header", "8", "1"), ("users", "in use", "2")]


def test_grids(spark, tmp_path):
    values = np.arange(12, dtype="<f4").reshape(4, 3)
    values[0, 0] = -1e32
    for packed in (False, True):
        path = write(tmp_path, encode.grid(values, packed), f"{packed}.grid")
        df = load(spark, path, "survey_grid")
        assert rows(df, "grid_row", "grid_col", "value")[4] == (1, 1, 4.0) and df.count() == 12
        assert load(spark, path, "survey_grid", dummyAsNull="true").where("value is null").count() == 1
        assert load(spark, path, "survey_grid", partitionBytes=1).rdd.getNumPartitions() == (2 if packed else 4)
        assert load(spark, path, "survey_grid_headers", validate="true").first()["diagnostics"] == []


def test_many_grids_are_planned_by_their_readers(spark, tmp_path):
    for i in range(3):
        write(tmp_path, encode.grid(np.arange(6, dtype="<f4").reshape(3, 2) + i, i == 1), f"{i}.grid")
    few = load(spark, str(tmp_path), "survey_grid")
    many = load(spark, str(tmp_path), "survey_grid", filesAsPartitions=2)
    assert many.rdd.getNumPartitions() == 3 and rows(many, "path", "grid_row", "grid_col", "value") == rows(few, "path", "grid_row", "grid_col", "value")


def test_broken_grids(spark, tmp_path):
    values = np.arange(12, dtype="<i2").reshape(4, 3)
    data = encode.grid(values, True, sign=1)
    short = load(spark, write(tmp_path, data[:-3], "short.grid"), "survey_grid")
    assert short.count() == 6
    found = load(spark, str(tmp_path / "short.grid"), "survey_grid_headers", validate="true").first()["diagnostics"]
    assert found == ["GRID_BLOCK", "GRID_COUNT"]
    plain = encode.grid(values, False, sign=1)
    assert load(spark, write(tmp_path, plain[:-3], "plain.grid"), "survey_grid").count() == 10
    with pytest.raises(Exception, match="hold no grid header"):
        load(spark, write(tmp_path, b"x" * 100, "tiny.grid"), "survey_grid").count()
    with pytest.raises(Exception, match="element size"):
        load(spark, write(tmp_path, b"\3" + plain[1:], "bad.grid"), "survey_grid").count()


def test_files_that_arrive(spark, tmp_path):
    folder, out, marks = (tmp_path / x for x in ("in", "out", "marks"))
    folder.mkdir()
    path = write(folder, basic())
    schema = load(spark, path).schema

    def drain():
        job = streaming.arriving(spark, str(folder), schema).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(marks)).trigger(availableNow=True).start()
        job.awaitTermination()
        return spark.read.schema(schema).parquet(str(out)).count()

    assert drain() == 5
    write(folder, basic(comp_level=2), "b.survey")
    assert drain() == 10
