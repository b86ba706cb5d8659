"""One broken file per rule."""

import pytest

from gridloom.codec.binary import MAP_MAGIC, INDEX_SIGNATURE
from gridloom.codec.header import grid_of, read_header, write_header
from gridloom.codec.tile import write_tile
from gridloom.operators import validation
from gridloom.sources.tilemap import feature_rows  # noqa: F401
from gridloom.verbs import validate
from tests import fixtures as fx

POI = {"lat": 1, "lon": 2, "layer": 0, "tags": [0], "name": "a", "house_number": None, "elevation": None}
WAY = {"sub_tile_bitmap": 1, "layer": 0, "tags": [0], "name": None, "house_number": None, "reference": None, "label_lat": None, "label_lon": None, "encoding": False, "explicit_num_blocks": False, "blocks": [[[[1, 2], [3, 4]]]]}
ONE = [{"si": 0, "base": 14, "min": 14, "max": 14, "pos": 0, "size": 0}]


def one_tile(body, **changes):
    h = fx.header(zoom_intervals=ONE, max_lat=52485000, max_lon=13380000, **changes)
    x0, y0, _, _ = grid_of(h, ONE[0])
    return fx.build(h, {(0, x0, y0): body(x0, y0)})


def good(debug=False, pois=(POI,), ways=(WAY,)):
    return one_tile(lambda x, y: write_tile([list(pois)], [list(ways)], x, y, debug), has_debug=debug)


def cases():
    g, d = good(), good(True)
    h = read_header(g)
    pos = h["zoom_intervals"][0]["pos"]
    dpos = read_header(d)["zoom_intervals"][0]["pos"]
    yield "R01", b""
    yield "R02", fx.edited(g, 3, b"?")
    box = len(MAP_MAGIC) + 4 + 20
    yield "R03", fx.edited(g, box, g[box + 8 : box + 12] + g[box + 4 : box + 8] + g[box : box + 4])
    yield "R04", fx.edited(g, h["header_end"] - 19, bytes([15]))
    yield "R05", fx.edited(g, 20, (h["header_size"] + 1).to_bytes(4, "big"))
    yield "R06", g + b"x"
    yield "R07", fx.edited(g, pos + 5, b"\x05\x05")
    yield "R08", fx.edited(g, pos + 5, b"\xff\xff\xff\xff\xff\xff")
    yield "R09", fx.edited(d, dpos, b"---")
    yield "R10", fx.edited(g, pos, (1).to_bytes(5, "big"))
    yield "R11", fx.edited(g, pos, (9999).to_bytes(5, "big"))
    yield "R13", fx.edited(d, dpos + len(INDEX_SIGNATURE) + 5, b"?")
    yield "R14", fx.edited(d, d.index(b"***POI"), b"?")
    yield "R15", fx.edited(d, d.index(b"---Way"), b"?")
    yield "R16", fx.edited(g, pos + 7, b"\x01")
    yield "R17", good(pois=({**POI, "layer": 8},))
    yield "R18", good(ways=({**WAY, "layer": 8},))
    yield "R19", good(pois=({**POI, "tags": [77]},))
    yield "R20", good(ways=({**WAY, "tags": [77]},))
    way = len(write_tile([[POI]], [[]], 0, 0))
    yield "R21", fx.edited(g, pos + 5 + way, bytes([g[pos + 5 + way] + 1]))


@pytest.mark.parametrize("rule, data", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_rule(spark, tmp_path, rule, data):
    (tmp_path / "m.map").write_bytes(data)
    assert {r.rule for r in validate(spark, str(tmp_path / "m.map")).collect()} == {rule}


def test_falling_offsets_and_light_lengths(spark, tmp_path):
    data = fx.random_map(5)
    h = read_header(data)
    pos = h["zoom_intervals"][2]["pos"]
    (tmp_path / "m.map").write_bytes(fx.edited(data, pos + 5, h["zoom_intervals"][2]["size"].to_bytes(5, "big")))
    assert {r.rule for r in validate(spark, str(tmp_path / "m.map")).collect()} == {"R12"}
    from gridloom.codec.binary import FormatError
    from gridloom.codec.tile import read_tile

    body = bytearray(write_tile([[]], [[WAY]], 0, 0))
    body[3] = 120
    with pytest.raises(FormatError, match="R22"):
        read_tile(bytes(body), 0, 0, 1, light=True)


def test_valid_maps_have_no_violation(spark, tmp_path):
    for seed, debug in ((1, False), (2, True)):
        (tmp_path / f"{seed}.map").write_bytes(fx.random_map(seed, has_debug=debug))
    assert validate(spark, str(tmp_path)).count() == 0


def test_grid_rule():
    from gridloom.codec.binary import FormatError

    with pytest.raises(FormatError, match="R23"):
        grid_of(fx.header(min_lat=52510000, max_lat=-52000000), ONE[0])
    assert write_header(fx.header())[:20] == MAP_MAGIC and validation is not None
