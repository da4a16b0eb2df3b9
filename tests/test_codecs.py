import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from surveyloom.functions import codecs
from surveyloom.plans import encode


def stream(control, *items):
    return struct.pack("<H", control) + b"".join(items)


def copy(back, n):
    return bytes([(back >> 4) & 0xF0 | n - 1, back & 0xFF])


def link(data, marker=codecs.STORED, size=None, span=None):
    return struct.pack("<iii", len(data) if size is None else size, len(data) + 12 if span is None else span, marker) + data


HEAD = codecs.CHUNK_MAGIC + struct.pack("<ii", codecs.SPEED, 0)


@pytest.mark.parametrize(
    "data, want",
    [
        (stream(0, b"hello"), b"hello"),
        (stream(4, b"AB", copy(2, 2)), b"ABAB"),
        (stream(2, b"A", copy(1, 4)), b"AAAAA"),
        (stream(0, b"0123456789abcdef") + stream(0, b"xyz"), b"0123456789abcdefxyz"),
    ],
)
def test_groups(data, want):
    assert codecs.lzrw1(data, 0, len(want)) == want


def test_a_copy_from_before_the_start_is_an_error():
    with pytest.raises(codecs.CodecError):
        codecs.lzrw1(stream(1, copy(3, 2)), 0, 2)


@given(st.binary(min_size=1, max_size=400), st.integers(1, 16))
def test_round_trip(data, back):
    assert codecs.lzrw1(encode.lzrw1(data, back), 0, len(data)) == data
    assert codecs.lzrw1(encode.lzrw1(data, None), 0, len(data)) == data


def test_a_chain_of_links():
    packed = encode.lzrw1(b"b" * 16, 1)
    chain = HEAD + link(b"a" * 32) + link(packed, codecs.PACKED, size=16) + link(b"c" * 16) + b"\0" * 40
    assert codecs.speed_blob(chain, 64) == b"a" * 32 + b"b" * 16 + b"c" * 16
    assert codecs.speed_blob(chain, 0) == b"a" * 32 == codecs.speed_blob(chain, 8)
    for bad in (40, 65):  # a link too many, then padding that is no link
        with pytest.raises(codecs.CodecError):
            codecs.speed_blob(chain, bad)


@pytest.mark.parametrize("data", [HEAD + link(b"abc", marker=7), HEAD + link(b"abc", size=4), HEAD + link(b"abc", size=-1), HEAD, HEAD + link(b"abcdef")[:-2]])
def test_bad_links(data):
    with pytest.raises(codecs.CodecError):
        codecs.speed_blob(data, 0)


def test_zlib_and_its_padding():
    frame = codecs.CHUNK_MAGIC + struct.pack("<ii", codecs.SIZE, 0)
    assert codecs.unframe(frame + zlib.compress(b"values") + b"\0" * 99, 0) == b"values"
    with pytest.raises(codecs.CodecError):
        codecs.unframe(frame + b"nothing", 0)
    with pytest.raises(codecs.CodecError):
        codecs.unframe(codecs.CHUNK_MAGIC + struct.pack("<ii", 9, 0) + b"x", 0)


def test_chunks_are_found_anywhere():
    data = b"x" * 5 + HEAD + link(b"abc") + HEAD[:20]
    assert codecs.speed_chunks(data) == [(5, 3, 15, codecs.STORED), (36, None, None, None)]
