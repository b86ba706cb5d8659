"""The digest, and the command line over small files."""

import hashlib
import random
import struct

import pytest
import xxhash

from gridloom import __main__ as cli
from gridloom import verbs
from gridloom.codec import fingerprint as fp
from gridloom.codec.header import read_header
from gridloom.codec.tile import read_tile, write_tile
from tests import fixtures as fx


def test_feature_hashes_by_hand():
    tags = fp.TagHashes(["a=1", "b=2"])
    x = xxhash.xxh3_64_intdigest
    poi = {"lat": -1, "lon": 2, "layer": -5, "tags": [1, 0], "name": "ü", "house_number": None, "elevation": 7}
    head = struct.pack("<i", -1) + struct.pack("<i", 2) + bytes([0, 2, 0xA0]) + ((x(b"a=1") + x(b"b=2")) % 2**64).to_bytes(8, "little")
    assert len(head) == 19 and fp.poi_hash(poi, tags) == x(struct.pack("<i", 7), x("ü".encode(), x(head)))
    way = fx.way(random.Random(1), 2) | {"name": None, "house_number": "1a", "reference": None, "label_lat": None, "label_lon": None, "encoding": True, "explicit_num_blocks": False, "blocks": [[[[1, -2]]]], "tags": [0], "layer": 0, "sub_tile_bitmap": 513}
    body = write_tile([[]], [[way]], 0, 0)
    (light,) = read_tile(body, 0, 0, 1, light=True)[1][0],
    head = bytes([1, 2, 5, 1, 0x44]) + x(b"a=1").to_bytes(8, "little")
    assert fp.way_hash(light[0], tags) == x(bytes([1, 1, 1, 0x42]), x(b"1a", x(head)))


def test_digest_ignores_orders_and_dictionaries(spark, tmp_path):
    data = fx.random_map(6)
    h = read_header(data)
    bodies, water = {}, set()
    (tmp_path / "a.map").write_bytes(data)
    rng = random.Random(0)
    swap = {k: rng.sample(range(3), 3) for k in ("poi", "way")}  # old id -> new id
    for r in verbs.read_map(spark, str(tmp_path / "a.map")).raw.collect():
        z = h["zoom_intervals"][r.si]
        if r.is_water:
            water.add((r.si, r.x, r.y))
        if r.bytes:
            parts = read_tile(r.bytes, r.x, r.y, z["max"] - z["min"] + 1)
            new = [[rng.sample([{**f, "tags": [swap[k][t] for t in f["tags"]][::-1]} for f in row], len(row)) for row in part] for k, part in zip(("poi", "way"), parts)]
            bodies[r.si, r.x, r.y] = write_tile(*new, r.x, r.y)
    names = {f"{k}_tags": [h[f"{k}_tags"][swap[k].index(i)] for i in range(3)] for k in swap}
    (tmp_path / "b.map").write_bytes(fx.build({**h, **names}, bodies, water))
    one, two = (verbs.file_digest(spark, str(tmp_path / f"{k}.map")) for k in "ab")
    assert one == two and len(one) == 64
    assert one != verbs.file_digest(spark, str(tmp_path / "a.map"), ignore_timestamp=True)
    first = fp.header_bytes(h)
    assert hashlib.sha256(first).hexdigest() != one
    with pytest.raises(ValueError):
        (tmp_path / "d.map").write_bytes(fx.random_map(6, has_debug=True))
        verbs.file_digest(spark, str(tmp_path / "d.map"))


def test_command_line(spark, tmp_path, capsys):
    a, b, d, out = (str(tmp_path / n) for n in ("a.map", "b.map", "x.mfd", "out.map"))
    (tmp_path / "a.map").write_bytes(fx.random_map(1))
    (tmp_path / "b.map").write_bytes(fx.random_map(2))

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr().out

    assert run("validate", a)[0] == 0
    assert run("diff", a, a) == (0, "")
    assert run("diff", a, b)[0] == 1
    digest = run("hash", b)[1].strip()
    assert run("delta", a, b, "-o", d, "--semantic")[1].strip() == f"SEMANTIC_HASH: {digest}"
    assert digest in run("apply", a, d, "-o", out, "--semantic")[1]
    assert run("crop", a, "--bbox", "13.379,52.484,13.39,52.49", "--estimate-size")[1].strip().isdigit()
    assert run("dump", a, "--header")[1].startswith("[header]\n")
    assert "amenity=a" in run("tags", a)[1]
    assert run("edit", a, "-o", out, "-f", "--comment", "hi")[0] == 0
    assert run("merge", a, b, "-o", out, "-f")[0] == 0
