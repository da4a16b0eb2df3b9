import pytest
from helpers import rows, write

from surveyloom.api import Survey
from surveyloom.functions import registry as R
from surveyloom.plans import encode


def survey(spark, tmp_path, make) -> Survey:
    s = encode.Survey([("raw_mag", 5, 1), ("Easting", 5, 1)], [("L100", 100)], {(0, 0): [1.0], (0, 1): [2.0]})
    s.objects = [("", b"")] * len(make([0, 0, 0]))
    s.objects = make([encode.handle(s, j) for j in range(3)])
    return Survey(spark, write(tmp_path, s))


def test_settings(spark, tmp_path):
    s = survey(spark, tmp_path, lambda h: [(h[0], encode.reg([("UNITS", "old")])), (h[0], encode.reg([("UNITS", "nT"), ("LABEL", "Raw"), ("NOTHING", "")])), (h[1], encode.reg([("KEPT", "1"), ("LEFT", "2")], spare=1)), ("__7", encode.reg([("A1", "b")]))])
    assert rows(s.channel_settings(), "channel", "key", "value", "conflict") == [("Easting", "KEPT", "1", False), ("raw_mag", "LABEL", "Raw", False), ("raw_mag", "UNITS", "nT", True)]


@pytest.mark.parametrize("names, want", [(["Easting"], ("Easting", False)), (["Gone"], (None, False)), (["", "Easting", "Easting"], ("Easting", False)), (["Easting", "raw_mag"], (None, True))])
def test_roles(spark, tmp_path, names, want):
    s = survey(spark, tmp_path, lambda h: [("r", encode.reg([("DB_CHAN_X", n)])) for n in names])
    assert rows(s.coordinate_channels(), "role", "channel", "ambiguous") == [("X", *want), ("Y", None, False), ("Z", None, False)]


def _one(s):
    return s.projection_parameters().collect()


def test_projection_by_layout(spark, tmp_path):
    slots = [0.0, 141.0, None, None, 0.9996, 500000.0, 10000000.0, None]
    s = survey(spark, tmp_path, lambda h: [("p", encode.projection("UTM", 11, slots, transform=[1.0, 2.0, 3.0, 0.0, 0.0, 3.141592653589793 / 180 / 3600, 1.000002]))])
    (row,) = _one(s)
    assert row["central_meridian"] == 141.0 and row["method"] == "Transverse Mercator" and row["parameter_source"] == "binary"
    assert [p["value"] for p in row["method_parameters"]] == [0.0, 141.0, 0.9996, 500000.0, 10000000.0]
    assert row["datum_transform_parameters"] == pytest.approx([1, 2, 3, 0, 0, 1, 2], abs=1e-6)
    assert rows(s.coordinate_systems(), "pos", "name") == [(0, "UTM")]


def test_projection_texts(spark, tmp_path):
    slots = [52.0, 5.0, None, None, 0.9, 1.0, 2.0, None]
    text = lambda t: ("t", encode.reg([("_PJ_NAME", '"RD"'), ("_PJ_PROJECTION", t)]))
    named = '"Oblique Stereographic",52,5,0.9,1,2'
    (row,) = _one(survey(spark, tmp_path, lambda h: [("p", encode.projection("RD", 99, slots)), text('"Other",9'), text(named)]))
    assert (row["method"], row["parameter_source"], row["text_mismatch"], row["conflict"]) == ("Oblique Stereographic", "text", False, False)
    (row,) = _one(survey(spark, tmp_path, lambda h: [("p", encode.projection("RD", 99, slots)), text("garbage")]))
    assert (row["method"], row["method_parameters"], row["text_mismatch"]) == (None, None, True)
    (row,) = _one(survey(spark, tmp_path, lambda h: [("p", encode.projection("RD", 99, slots)), text('"Unheard of",52,5,0.9,1,2')]))
    assert (row["method"], row["parameter_source"]) == ("Unheard of", None)
    (row,) = _one(survey(spark, tmp_path, lambda h: [("p", encode.projection("RD", 14, slots)), text(named), ("p", encode.projection("RD", 14, [1.0] * 8))]))
    assert row["text_mismatch"] and row["conflict"] and row["parameters"] == [1.0] * 8


def test_makers(spark, tmp_path):
    make = lambda mark, params: encode.reg([], nested=encode.maker("a.gx", "Label", params, mark))
    s = survey(spark, tmp_path, lambda h: [(h[0], make(True, [("A", "old")])), (h[0], make(False, [("B", 'x="y"'), ("A", "")]))])
    (row,) = s.channel_makers().collect()
    assert (row["channel"], row["tool"], row["label"], row["conflict"]) == ("raw_mag", "a.gx", "Label", True)
    assert [(p["k"], p["v"]) for p in row["params"]] == [("B", 'x="y"'), ("A", "")]


@pytest.mark.parametrize("width", [82, 130])
def test_display_lists(spark, tmp_path, width):
    s = survey(spark, tmp_path, lambda h: [("Display List", encode.display_list([("raw_mag", int(str(h[0]).strip("_"))), ("gone", 999), ("x", "no")], width))])
    assert rows(s.display_lists(), "pos", "label", "channel") == [(0, "raw_mag", "raw_mag"), (1, "gone", None)]


def test_decoders_refuse_what_they_do_not_know():
    assert R.settings(b"") is None and R.projection(b"\0" * 700) is None and R.creation(b"") is None and R.display_list(b"") is None and R.nested(b"x" * 200) is None
