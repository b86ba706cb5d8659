import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.codec.binary import FormatError, Reader, Writer
from gridloom.codec.header import read_header, write_header
from gridloom.codec.patch import decode, encode, read_patch_file, write_patch_file
from gridloom.codec.tile import normalised, read_blob, read_tile, remapped, write_blob, write_tile, zoom_bytes
from tests import fixtures as fx


@pytest.mark.parametrize("n, raw", [(0, "00"), (127, "7f"), (128, "8001"), (16383, "ff7f"), (16384, "808001")])
def test_unsigned_vectors(n, raw):
    w = Writer()
    w.unsigned(n)
    assert w.hex() == raw and Reader(w).unsigned() == n


@pytest.mark.parametrize("n, raw", [(0, "00"), (63, "3f"), (-63, "7f"), (64, "c000"), (-64, "c040"), (8191, "ff3f"), (-8191, "ff7f"), (8192, "80c000")])
def test_signed_vectors(n, raw):
    w = Writer()
    w.signed(n)
    assert w.hex() == raw and Reader(w).signed() == n


@given(st.integers(0, 2**32 - 1), st.integers(-(2**31) + 1, 2**31 - 1), st.text(st.characters(exclude_categories=("Cs",))))
def test_numbers_and_text_round_trip(u, s, t):
    w = Writer()
    w.unsigned(u), w.signed(s), w.text(t)
    r = Reader(w)
    assert (r.unsigned(), r.signed(), r.text(), r.left) == (u, s, t, 0)


def test_minus_zero_and_invalid_utf8():
    assert Reader(b"\x40").signed() == 0
    raw = b"\x02\xff\xfe"
    w = Writer()
    w.text(Reader(raw).text())
    assert bytes(w) == raw


def test_special_bytes():
    w = write_tile([[{"lat": 0, "lon": 0, "layer": 0, "tags": [0], "name": None, "house_number": None, "elevation": None}]], [[]], 0, 0)
    assert w[5:6] == b"\x51"
    assert write_tile([[]], [[]], 0, 0) == b"\0\0\0"


@pytest.mark.parametrize("debug", [False, True])
def test_tile_round_trip(debug):
    rng = random.Random(1)
    pois = [[fx.poi(rng) for _ in range(n)] for n in (0, 3, 9)]
    ways = [[fx.way(rng) for _ in range(n)] for n in (4, 0, 7)]
    body = write_tile(pois, ways, 5, 6, debug)
    assert read_tile(body, 5, 6, 3, debug, check=True) == (pois, ways)
    light = read_tile(body, 5, 6, 3, debug, light=True)[1]
    assert all(f["blocks"] is None and f["block_bytes"] for row in light for f in row)
    blobs = zoom_bytes(body, 5, 6, 3, debug)
    assert [read_blob(b) for b in blobs] == list(zip(pois, ways))


def test_header_round_trip():
    for h in (fx.header(), fx.header(has_debug=True, start_lat=-1, start_lon=2, start_zoom=0, language="", comment="ü\n", created_by="x", creation_date=2**64 - 1, poi_tags=[])):
        got = read_header(write_header(h))
        assert {k: got[k] for k in h} == h


@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 50))
def test_patches(target, reference, cut):
    for t, r in ((target, reference), (reference[cut:] + target + reference[:cut], reference), (target, b"")):
        assert decode(encode(t, r), r) == t


def test_patch_compresses_copies_and_checks_bounds():
    ref = random.Random(2).randbytes(20_000)
    target = ref[:9000] + b"new" + ref[9000:]
    assert len(encode(target, ref)) < 40
    with pytest.raises(FormatError):
        decode(encode(target, ref), ref[:100])


def test_patch_file_round_trip():
    h = fx.header(poi_tags=["amenity=b", "new=1"])
    records = [(1, 7, 3, 1, {0: b"abc", 4: b""}), (0, 2, 9, 2, {}), (1, 5, 3, 0, {1: b"x"}), (1, 1, 4, 0, {2: b"y"})]
    data = write_patch_file(h, (["amenity=a", "amenity=b"], []), records)
    got, rows = read_patch_file(data, (["amenity=a", "amenity=b"], []))
    assert (got["poi_tags"], got["way_tags"]) == (h["poi_tags"], h["way_tags"])
    assert rows == sorted(records, key=lambda r: (r[0], r[2], r[1]))


def test_order_is_total_and_remap_drops():
    rng = random.Random(3)
    pois, ways = [fx.poi(rng) for _ in range(30)], [fx.way(rng) for _ in range(30)]
    first = write_blob(*normalised(pois, ways))
    rng.shuffle(pois), rng.shuffle(ways)
    assert write_blob(*normalised(pois, ways)) == first
    assert remapped([{"tags": [0, 1]}, {"tags": [1]}], [None, 5]) == [{"tags": [5]}]
