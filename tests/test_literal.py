"""A survey file laid out by hand, byte for byte; nothing here is taken from the reader or the encoder."""

import struct

import numpy as np

from surveyloom.__main__ import main
from surveyloom.sources.survey import SurveyReader  # noqa: F401  the source must be importable without Spark running

PAGE = 512


def put(data: bytearray, at: int, code: str, *values) -> None:
    struct.pack_into("<" + code, data, at, *values)


def block(index: int, class_code: int, rows: int, type_code: int, raw: bytes) -> bytes:
    pages = -(-(48 + len(raw)) // PAGE)
    out = bytearray(pages * PAGE)
    out[0:4] = b"\xcc\xcc\x00\xff"
    put(out, 4, "iiiii", pages, pages, index, 0, class_code)
    put(out, 24, "ii", 0, 0)
    put(out, 32, "d", 1.0)
    put(out, 40, "ii", rows, type_code)
    out[48 : 48 + len(raw)] = raw
    return bytes(out)


def survey() -> bytes:
    """One line with a double and a two-character string channel; two slots of each table."""
    head = bytearray(256)
    head[0:4] = b"!CBD"
    put(head, 8, "iiii", 0x10020000, 264, 0, 0)
    for at, value in ((24, 2), (28, 1), (36, 2), (40, 1), (44, 5), (48, 4), (100, PAGE), (108, 3), (120, 0)):
        put(head, at, "i", value)
    directory = bytearray(24 + 5 * 6)
    put(directory, 24, "IH", 0x80000000, 1)
    put(directory, 30, "IH", 0x80000001, 1)
    symbols = bytearray(128)
    put(symbols, 76, "i", 65536)
    lines = bytearray(256)
    lines[0:4] = b"L10\0"
    put(lines, 76, "i", 100)
    lines[104:124] = bytes.fromhex("aec59df414e384bcd6bf91c6176e05b5b5b89346")
    put(lines, 128 + 76, "i", 65536)
    channels = bytearray(256)
    for at, name, code in ((0, b"mag", 5), (128, b"id", -2)):
        channels[at : at + len(name)] = name
        put(channels, at + 76, "hh", code, 0)
        put(channels, at + 84, "hh", 0, 10)
        put(channels, at + 88, "i", 3)
        put(channels, at + 100, "d", 1.0)
        put(channels, at + 108, "hh", 5, 1)
    users = bytearray(128)
    users[0:5] = b"SUPER"
    put(users, 76, "i", 131072)
    put(users, 116, "i", -1)
    front = bytes(head + directory + symbols + lines + channels + users).ljust(3 * PAGE, b"\0")
    return front + block(0, 200, 3, 5, np.array([1.5, -2.0, 4.25]).tobytes()) + block(1, 200, 3, -2, b"a\0bcd\0")


def test_rows_of_a_file_laid_out_by_hand(spark, tmp_path):
    from surveyloom import sources

    sources.register(spark)
    path = tmp_path / "hand.survey"
    path.write_bytes(survey())
    rows = spark.read.format("survey").load(str(path)).orderBy("fid").select("line", "line_category", "line_slot", "fid", "mag", "id").collect()
    assert [tuple(r) for r in rows] == [("L10", "NORMAL", 0, 0, 1.5, "a"), ("L10", "NORMAL", 0, 1, -2.0, "bc"), ("L10", "NORMAL", 0, 2, 4.25, "d")]
    catalog = lambda table: spark.read.format("survey_catalog").option("table", table).option("validate", "true").load(str(path))
    assert catalog("diagnostics").count() == 0 and catalog("conformance").count() == 0
    head = catalog("headers").first()
    assert (head["chans_max"], head["lines_max"], head["page_size"], head["data_slots"], head["signature_common"]) == (2, 2, PAGE, 4, True)


def test_report_of_a_file(tmp_path, capsys):
    good, bad = tmp_path / "hand.survey", tmp_path / "bad.survey"
    good.write_bytes(survey())
    bad.write_bytes(survey()[:-40])
    assert main([str(good), str(bad)]) == 0
    told = capsys.readouterr().out
    assert "channel 0 mag: type 5" in told and "1 lines of category NORMAL" in told and "PAST_EOF" in told
