import struct

import numpy as np
import pytest
from helpers import basic, write
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from surveyloom.functions import cells, layout
from surveyloom.functions.layout import SurveyFile, open_file
from surveyloom.plans import encode


def values(path, **options):
    s = SurveyFile(path, **options)
    with open_file(path) as f:
        found = {(x.name, c.var_name): cells.decode(s, f, c, b, line=x.name).to_pylist() for x in s.lines for c, b in s.on_line(x)}
    return found, [d.code for d in s.diagnostics]


WANT = {("L100", "Fiducial"): [1, 2, 3], ("L100", "Easting"): [10.0, 20.0, -1e32], ("L100", "Depths"): [[0, 1, 2], [3, 4, 5], [6, 7, 8]], ("L200", "Fiducial"): [4, 5], ("L200", "Easting"): [30.0, 40.0]}


@pytest.mark.parametrize("options", [{}, {"comp_level": 2}, {"comp_level": 1}, {"comp_level": 1, "speed": "copies"}, {"comp_level": 1, "speed": "stored"}, {"comp_level": 1, "speed": "bare"}, {"line_table": "shifted"}, {"directory": False}])
def test_values(tmp_path, options):
    assert values(write(tmp_path, basic(**options))) == (WANT, [])


def test_junk_before_the_first_block(tmp_path):
    found, codes = values(write(tmp_path, basic(junk_pages=2)))
    assert found == WANT and codes == ["PAGES_SKIPPED"]


def test_stale_copies(tmp_path):
    stale = {(0, 1): [0.0, 0.0, 0.0]}
    for after in (False, True):
        assert values(write(tmp_path, basic(stale=stale, stale_after=after)))[0] == WANT
    found, codes = values(write(tmp_path, basic(stale=stale, stale_after=True, directory=False)))
    assert found["L100", "Easting"] == [0.0, 0.0, 0.0] and codes == ["DUPLICATE_NO_DIRECTORY"]


def test_unlisted_and_invalid(tmp_path):
    path = write(tmp_path, basic(unlisted={(0, 1)}))
    found, codes = values(path)
    assert ("L100", "Easting") not in found and codes == ["UNLISTED_SKIPPED"]
    assert values(path, include_unlisted=True)[0] == WANT
    for wrong in ("page", "pages", "flag", "index"):
        found, codes = values(write(tmp_path, basic(invalid={(0, 1): wrong})))
        assert found == WANT and codes == ["DIRECTORY_INVALID"]


def test_strings(tmp_path):
    s = encode.Survey([("Name", -4, 1)], [("L", 100)], {(0, 0): ["ab", "wxyz", "", "é"]})
    assert values(write(tmp_path, s))[0] == {("L", "Name"): ["ab", "wxyz", "", "�"]}


def test_what_is_no_survey(tmp_path):
    for data in (b"", b"!CB", b"nothing of the kind" * 20):
        s = SurveyFile(write(tmp_path, data))
        assert not s.is_survey and s.channels == [] and s.lines == [] and len(s.blocks) == 0 and s.live == {}
        assert s.diagnostics[0].code == "BAD_MAGIC"


@pytest.mark.parametrize("cut", [4, 30, 100, 110, 124, 300, 900, 1500, 2000])
def test_cut_off_before_the_blocks(tmp_path, cut):
    data = encode.encode(basic())
    s = SurveyFile(write(tmp_path, data[:cut]))
    _ = s.header, s.channels, s.lines, s.live, s.symbols, s.admin_objects
    assert s.diagnostics


def test_cut_off_in_the_blocks(tmp_path):
    data = encode.encode(basic(comp_level=2))
    whole = SurveyFile(write(tmp_path, data))
    last = int(whole.blocks["offset"][-1])
    for cut, code in ((last + 20, "MID_HEADER"), (last + 58, "PAST_EOF"), (last + 100, "PAST_EOF")):
        found, codes = values(write(tmp_path, data[:cut]))
        assert code in codes
        assert {k: v for k, v in found.items() if k != ("L200", "Easting")} == {k: v for k, v in WANT.items() if k != ("L200", "Easting")}


def test_broken_blocks(tmp_path):
    data = bytearray(encode.encode(basic()))
    at = int(SurveyFile(write(tmp_path, bytes(data))).blocks["offset"][1])
    broken = data[:]
    broken[at : at + 4] = b"junk"
    assert values(write(tmp_path, bytes(broken)))[1] == ["PAGES_SKIPPED"]
    broken = data[:]
    struct.pack_into("<i", broken, at + 4, 0)
    assert "BAD_NPAGES" in values(write(tmp_path, bytes(broken)))[1]
    broken = data[:]
    struct.pack_into("<i", broken, at + 40, 10_000)
    found, codes = values(write(tmp_path, bytes(broken)))
    assert "SHORT_DATA" in codes
    broken = data[:]
    struct.pack_into("<i", broken, at + 40, -1)
    assert ("L100", "Easting") not in values(write(tmp_path, bytes(broken)))[0]


def test_ragged_arrays_lose_their_tail(tmp_path):
    s = basic()
    s.cells[0, 2] = np.arange(8.0)
    found, codes = values(write(tmp_path, s))
    assert found["L100", "Depths"] == [[0, 1, 2], [3, 4, 5]] and codes == ["RAGGED_ARRAY"]


def test_unknown_types(tmp_path):
    data = encode.encode(basic()).replace(b"Easting" + b"\0" * 69 + struct.pack("<h", 5), b"Easting" + b"\0" * 69 + struct.pack("<h", 11))
    found, codes = values(write(tmp_path, data))
    assert found["L100", "Easting"] == [] and set(codes) == {"UNKNOWN_TYPE"}


def test_names():
    assert layout.clean_name(b"ab\0cd") == ("ab", True)
    assert layout.clean_name(b"ab") == ("ab", False)
    assert layout.clean_name(b"a\x07\0") == ("a\x07", False)


NUMBERS = st.lists(st.integers(-100, 100), min_size=0, max_size=40)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_any_survey_comes_back(tmp_path, data):
    codes = data.draw(st.lists(st.sampled_from([0, 2, 3, 4, 5, 8, -6]), min_size=1, max_size=4))
    n_lines = data.draw(st.integers(1, 4))
    held, want = {}, {}
    for i in range(n_lines):
        for j, code in enumerate(codes):
            if data.draw(st.booleans()):
                v = data.draw(NUMBERS)
                held[i, j] = [str(x) for x in v] if code < 0 else v
                want[f"L{i}", f"c{j}"] = held[i, j]
    options = {"comp_level": data.draw(st.integers(0, 2)), "speed": data.draw(st.sampled_from(["literal", "copies", "stored"])), "directory": data.draw(st.booleans())}
    s = encode.Survey([(f"c{j}", code, 1) for j, code in enumerate(codes)], [(f"L{i}", 100) for i in range(n_lines)], held, **options)
    assert values(write(tmp_path, s))[0] == want
