import numpy as np
import pytest
from helpers import basic, rows, write

from surveyloom.api import Survey
from surveyloom.plans import encode


def repeated(both: bool) -> encode.Survey:
    cells = {(0, 0): [1, 2], (0, 2): [3.0, 4.0]} | ({(0, 1): [5.0, 6.0]} if both else {})
    return encode.Survey([("Fiducial", 3, 1), ("Dup", 5, 1), ("Dup", 5, 1)], [("L100", 100)], cells)


def test_names(spark, tmp_path):
    s = Survey(spark, write(tmp_path, repeated(False)))
    assert s.channel_names == ["Fiducial", "Dup", "Dup"] and s.line_names == ["L100"]
    with pytest.raises(KeyError):
        s.channel("nothing")
    with pytest.raises(ValueError):
        s.channel("Dup")
    with pytest.raises(IndexError):
        s.channel(("Dup", 2))
    assert s.channel(("Dup", 1)).slot == 2
    assert s.channel_on_line("L100", "Dup").slot == 2
    assert s.channels_on_line("L100") == ["Fiducial", "Dup"]
    assert rows(s.read("L100", "Dup"), "fid", "value") == [(0, 3.0), (1, 4.0)]
    assert s.read("L100", ("Dup", 0)).count() == 0
    assert s.to_dataframe().columns[-1] == "Dup[1]"
    assert s.attributes("L100")["line_category"] == "NORMAL"
    both = Survey(spark, write(tmp_path, repeated(True), "both"))
    with pytest.raises(ValueError):
        both.read("L100", "Dup")


def test_not_a_survey(spark, tmp_path):
    with pytest.raises(ValueError):
        Survey(spark, write(tmp_path, b"nothing"))


def test_exports(spark, tmp_path):
    s = basic()
    s.channels += [("Northing", 5, 1), ("Tag", -2, 1)]
    s.cells |= {(0, 3): [1.0, 2.0, 3.0], (0, 4): ["a", "b", "c"]}
    survey = Survey(spark, write(tmp_path, s))
    assert rows(survey.read("L100", "Depths"), "fid", "value")[1] == (1, [3.0, 4.0, 5.0])
    dense = survey.dense()
    assert rows(dense.where("line = 'L200'"), "fid", "Fiducial", "Northing", "Tag")[2] == (2, -2147483647, -1e32, "")
    assert rows(survey.points(), "line", "x", "y", "z", "Tag") == [("L100", -1e32, 3.0, 0.0, "c"), ("L100", 10.0, 1.0, 0.0, "a"), ("L100", 20.0, 2.0, 0.0, "b")]
    assert survey.points(z="Fiducial").agg({"z": "sum"}).first()[0] == 6.0
    assert "Depths[2]" in survey.flattened().columns
    assert survey.cells("L200").count() == 2 and survey.to_dataframe("L200", channels=["Easting"]).columns[-1] == "Easting"
    assert survey.diagnostics(validate=True).count() == 0 and survey.conformance().count() == 0


def test_lines_without_data(spark, tmp_path):
    s = encode.Survey([("Easting", 5, 1)], [("L100", 100), ("EMPTY", 100)], {(0, 0): np.arange(2.0)})
    survey = Survey(spark, write(tmp_path, s))
    assert survey.line_names == ["L100", "EMPTY"] and survey.channels_on_line("EMPTY") == []
    assert survey.to_dataframe().select("line").distinct().count() == 1
    assert survey.read("EMPTY", "Easting").count() == 0


def test_cells_that_are_not_there(spark, tmp_path):
    s = encode.Survey([("Easting", 5, 1), ("Mag", 5, 1)], [("L100", 100), ("L200", 100)], {(0, 0): np.arange(2.0), (0, 1): np.arange(2.0), (1, 1): np.arange(5.0)})
    survey = Survey(spark, write(tmp_path, s))
    assert rows(survey.absent_cells(), "line", "channel") == [("L200", "Easting")]
    assert survey.read("L200", "Easting").count() == 0 and survey.block("L200", "Easting").count() == 0
    assert [(d["code"], d["line"], d["channel"]) for d in survey.diagnostics().collect()] == [("CELL_ABSENT", "L200", "Easting")]
    assert rows(survey.extents(), "channel", "lines", "most_rows", "widest") == [("Easting", 1, 2, None), ("Mag", 2, 5, None)]


def test_one_line_with_what_is_known_of_it(spark, tmp_path):
    survey = Survey(spark, write(tmp_path, basic()))
    one = survey.line_table("L200")
    assert list(one["Easting"]) == [30.0, 40.0] and one.attrs["line_name"] == "L200" and one.attrs["channels"]["Easting"]["type_code"] == 5


def test_points_as_files(spark, tmp_path):
    s = encode.Survey([("Easting", 5, 1), ("Northing", 5, 1)], [("L1", 100), ("L1", 100), ("G", 200)], {(i, j): np.arange(3.0) + i for i in range(3) for j in range(2) if (i, j) != (1, 1)})
    survey = Survey(spark, write(tmp_path, s))
    survey.write_points(str(tmp_path / "points"))
    assert rows(spark.read.parquet(str(tmp_path / "points")), "line_category", "x") == [("GROUP", 2.0), ("GROUP", 3.0), ("GROUP", 4.0), ("NORMAL", 0.0), ("NORMAL", 1.0), ("NORMAL", 2.0)]
    nowhere = Survey(spark, write(tmp_path, encode.Survey([("Mag", 5, 1)], [("L1", 100)], {(0, 0): [1.0]}), "nowhere")).points()
    assert nowhere.count() == 0 and nowhere.columns[:3] == ["x", "y", "z"]


def test_dense_lines_of_one_name(spark, tmp_path):
    s = encode.Survey([("Mag", 5, 1), ("Depths", 3, 2)], [("L1", 100), ("L1", 100)], {(0, 0): [1.0, 2.0], (1, 0): [5.0], (1, 1): [7, 8]})
    dense = Survey(spark, write(tmp_path, s)).dense()
    assert rows(dense, "line_slot", "line", "fid", "Mag", "Depths") == [(0, "L1", 0, 1.0, [-2147483647] * 2), (0, "L1", 1, 2.0, [-2147483647] * 2), (1, "L1", 0, 5.0, [7, 8]), (1, "L1", 1, -1e32, [-2147483647] * 2)]
