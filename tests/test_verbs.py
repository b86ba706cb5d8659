"""Properties of the file verbs on random maps."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom import verbs
from gridloom.codec.header import read_header
from gridloom.sources.tilemap import load_header, read_part, register
from tests import fixtures as fx


@pytest.fixture(scope="module")
def maps(tmp_path_factory):
    d = tmp_path_factory.mktemp("maps")
    tags = ["amenity=b", "amenity=a", "shop=d"]
    made = {"a": fx.random_map(1), "b": fx.random_map(2, poi_tags=tags, comment="b"), "c": fx.random_map(3, way_tags=["water=z", "road=x"], creation_date=5)}
    for k, v in made.items():
        (d / f"{k}.map").write_bytes(v)
    return d


def clean(found):
    return all(df.count() == 0 for df in found.values())


QUIET = {"ignore_comment": True, "ignore_timestamp": True}


def test_source_parts_and_pushdown(spark, maps):
    p = str(maps / "a.map")
    assert read_part(spark, p, "header").count() == 1
    index = read_part(spark, p, "tile_index", stretch=3)
    raw = read_part(spark, p, "tile_raw")
    assert index.where("length > 0").count() == raw.where("bytes is not null").count() > 5
    row = raw.where("length > 0").orderBy(F.desc("si"), "x").first()
    one = raw.where((F.col("si") == row.si) & (F.col("x") == row.x) & (F.col("y") == row.y)).collect()
    assert [r.bytes for r in one] == [row.bytes]
    register(spark)
    many = spark.read.format("tilemap").option("part", "header").load(str(maps))
    assert {r.map_id for r in many.collect()} == {"a", "b", "c"}


def test_diff_with_itself_and_others(spark, maps):
    a, b = str(maps / "a.map"), str(maps / "b.map")
    assert clean(verbs.diff(spark, a, a))
    found = verbs.diff(spark, a, b)
    assert found["tiles"].count() > 0 and {r.field for r in found["header"].collect()} == {"comment"}


def test_dump_load_round_trip(spark, maps, tmp_path):
    for k in "ab":
        src = str(maps / f"{k}.map")
        (tmp_path / f"{k}.txt").write_text("\n".join(verbs.dump(spark, src, all=True)) + "\n")
        verbs.load(spark, str(tmp_path / f"{k}.txt"), str(tmp_path / f"{k}.map"))
        assert verbs.validate(spark, str(tmp_path / f"{k}.map")).count() == 0
        assert clean(verbs.diff(spark, src, str(tmp_path / f"{k}.map")))


def test_delta_apply_chain(spark, maps, tmp_path):
    names = ["a", "b", "c", "a"]
    deltas = []
    for i, (x, y) in enumerate(zip(names, names[1:])):
        out = str(tmp_path / f"{i}.mfd")
        assert verbs.delta(spark, str(maps / f"{x}.map"), str(maps / f"{y}.map"), out) > 0
        deltas.append(out)
        verbs.apply(spark, str(maps / f"{names[0]}.map"), deltas, str(tmp_path / f"{i}.map"))
        assert verbs.validate(spark, str(tmp_path / f"{i}.map")).count() == 0
        assert clean(verbs.diff(spark, str(maps / f"{y}.map"), str(tmp_path / f"{i}.map")))
    assert verbs.delta(spark, str(maps / "a.map"), str(maps / "a.map"), str(tmp_path / "none.mfd")) == 0
    rows = spark.read.format("tilemap_patch").option("base", str(maps / "a.map")).load(deltas[0])
    assert rows.count() > 0


def test_apply_across_boxes(spark, maps, tmp_path):
    small = str(tmp_path / "small.map")
    (tmp_path / "small.map").write_bytes(fx.random_map(9, max_lon=13400000))
    chain = []
    for i, (x, y) in enumerate((("a", small), (small, "b"))):
        files = [p if p == small else str(maps / f"{p}.map") for p in (x, y)]
        chain.append(str(tmp_path / f"s{i}.mfd"))
        verbs.delta(spark, *files, chain[-1])
    out = str(tmp_path / "out.map")
    verbs.apply(spark, str(maps / "a.map"), chain, out)
    assert clean(verbs.diff(spark, str(maps / "b.map"), out))


def test_merge_keeps_every_feature(spark, maps, tmp_path):
    out = str(tmp_path / "m.map")
    inputs = [str(maps / f"{k}.map") for k in "abc"]
    verbs.merge(spark, inputs, out)
    count = lambda p: {(r.kind, r.zoom): r["count"] for r in verbs.read_map(spark, p).feature.groupBy("kind", "zoom").count().collect()}
    assert count(out) == count(inputs)
    assert verbs.validate(spark, out).count() == 0
    h = load_header(out)
    used = verbs.read_map(spark, out).feature.select("kind", F.explode("tags").alias("t")).groupBy("kind", "t").count().collect()
    by_use = sorted(((-r["count"], r.t) for r in used if r.kind == "poi"))
    assert h["poi_tags"] == [t for _, t in by_use]
    with pytest.raises(FileExistsError):
        verbs.merge(spark, inputs, out)
    with pytest.raises(ValueError):
        verbs.merge(spark, inputs[:1], out, force=True)


def test_crop(spark, maps, tmp_path):
    a, out = str(maps / "a.map"), str(tmp_path / "c.map")
    verbs.crop(spark, a, out, bbox=(-10, 40, 20, 60))
    assert clean(verbs.diff(spark, a, out, **QUIET))
    box = (13.379, 52.484, 13.39, 52.49)
    size = verbs.estimate_size(spark, a, bbox=box)
    h = verbs.crop(spark, a, out, bbox=box, force=True)
    assert h["file_size"] == size["file_bytes"] == (tmp_path / "c.map").stat().st_size < (maps / "a.map").stat().st_size
    assert verbs.validate(spark, out).count() == 0
    verbs.crop(spark, a, out, center=(52.49, 13.39), distance=0.5, force=True)
    with pytest.raises(ValueError):
        verbs.crop(spark, a, out, bbox=(1, 1, 2, 2), force=True)
    with pytest.raises(ValueError):
        verbs.crop(spark, a, out, force=True)


def test_edit_hash_tags(spark, maps, tmp_path):
    a, out = str(maps / "a.map"), str(tmp_path / "e.map")
    verbs.edit(spark, a, out, comment="new", timestamp=7)
    h = load_header(out)
    assert (h["comment"], h["creation_date"]) == ("new", 7)
    assert verbs.semantic_hash(spark, a) != verbs.semantic_hash(spark, out)
    assert verbs.semantic_hash(spark, a, **QUIET) == verbs.semantic_hash(spark, out, **QUIET)
    assert verbs.semantic_hash(spark, str(maps / "b.map"), **QUIET) != verbs.semantic_hash(spark, a, **QUIET)
    with pytest.raises(ValueError):
        verbs.edit(spark, a, out, force=True)
    t = verbs.tags(spark, [a, str(maps / "b.map")]).toPandas()
    assert set(t[t.kind == "poi"].tag) == {"amenity=a", "amenity=b", "shop=c", "shop=d"}
    zooms = [c for c in t.columns if c[0] == "z" and c[1:].isdigit()]
    assert (t[zooms].sum(axis=1) == t["count"]).all()


def test_hash_ignores_order(spark, tmp_path):
    data = fx.random_map(4)
    h = read_header(data)
    (tmp_path / "x.map").write_bytes(data)
    f = verbs.read_map(spark, str(tmp_path / "x.map")).feature
    from gridloom.sources.mapfile import encode_tiles, write_map_file

    rng = random.Random(0)
    tags = {k: rng.sample(h[k], len(h[k])) for k in ("poi_tags", "way_tags")}
    tiles = encode_tiles(f, {**h, **tags}).join(read_part(spark, str(tmp_path / "x.map"), "tile_index").select("si", "x", "y", "is_water"), ["si", "x", "y"], "full_outer")
    write_map_file({**h, **tags}, tiles, str(tmp_path / "y.map"))
    assert verbs.semantic_hash(spark, str(tmp_path / "x.map")) == verbs.semantic_hash(spark, str(tmp_path / "y.map"))


def test_tag_report_lists_every_tag(spark, maps, tmp_path):
    h = fx.header(poi_tags=[f"amenity=t{i:04}" for i in range(1300)])
    (tmp_path / "many.map").write_bytes(fx.build(h, {}))
    lines = list(verbs.tag_report(spark, [str(tmp_path / "many.map"), str(maps / "a.map")]))
    assert sum(x.startswith("amenity=t") for x in lines) == 1300
    heading = next(x for x in lines if x.startswith("tag\t"))
    assert lines.count(heading) >= 1302 // 20 and lines[0] == "# poi" and "# way" in lines
    assert all(len(x.split("\t")) == len(heading.split("\t")) for x in lines if not x.startswith("#"))
    stats = {(r.kind, r.tag): r for r in verbs.tags(spark, [str(tmp_path / "many.map"), str(maps / "a.map")]).collect()}
    row = dict(zip(heading.split("\t"), next(x for x in lines if x.startswith("road=x\t")).split("\t")))
    n = stats["way", "road=x"]["count"]
    assert int(row["count"]) == n - n % 10 ** (len(str(n)) - 1)


def test_merge_falls_back_to_the_interval_that_contains_a_zoom(spark, maps, tmp_path):
    """The second map has one interval for all levels: its tiles of the same coordinates take part."""
    from gridloom.codec.header import grid_of
    from gridloom.codec.tile import write_tile

    one = fx.header(zoom_intervals=[{"si": 0, "base": 12, "min": 0, "max": 16, "pos": 0, "size": 0}])
    x, y = grid_of(one, one["zoom_intervals"][0])[:2]
    rng = random.Random(3)
    rows = [[fx.poi(rng)] if z in (9, 15) else [] for z in range(17)]
    (tmp_path / "one.map").write_bytes(fx.build(one, {(0, x, y): write_tile(rows, [[] for _ in rows], x, y)}))
    (tmp_path / "empty.map").write_bytes(fx.build(fx.header(), {}))
    out = str(tmp_path / "out.map")
    verbs.merge(spark, [str(tmp_path / "empty.map"), str(tmp_path / "one.map")], out)
    got = [(r.si, r.x, r.y, r.zoom) for r in read_part(spark, out, "feature").collect()]
    assert got == [(1, x, y, 9)]  # level 15 is another interval's, whose grid lacks these coordinates


def test_too_many_tags_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(verbs, "MOST_TAGS", 2)
    df = spark.createDataFrame([("poi", ["a", "b"]), ("way", ["a", "b", "c"])], "kind string, tags array<string>")
    with pytest.raises(ValueError, match="way_tags"):
        verbs.ranked_tags(df)
    assert verbs.ranked_tags(df.where("kind = 'poi'")) == {"poi_tags": ["a", "b"], "way_tags": []}


def test_dump_tells_the_stored_way_offset(spark, maps):
    from gridloom.codec.tile import stored_way_offset

    p = str(maps / "a.map")
    zooms = {z["si"]: z["max"] - z["min"] + 1 for z in load_header(p)["zoom_intervals"]}
    want = {f'"{r.si}/{r.x}/{r.y}"': stored_way_offset(r.bytes, zooms[r.si]) if r.bytes else 0 for r in read_part(spark, p, "tile_raw").collect()}
    got, tile = {}, None
    for line in verbs.dump(spark, p, all=True):
        if line.startswith('id = "'):
            tile = line[5:]
        elif line.startswith("first_way_offset = "):
            got[tile] = int(line[19:])
    assert got == want and any(want.values())


def test_a_broken_fold_shows(spark, monkeypatch):
    """The apply queries are no identity: without its patches a tile stays what it was."""
    from gridloom.plans import codec_queries as C

    tile = lambda v, n: {"version": v, "is_water": False, "pois": [{"zi_index": 0, "lat": i, "lon": v, "layer": 0, "tags": ["t"], "feat_name": None, "house_number": None, "elevation": None} for i in range(n)], "ways": None}
    row = ("m", 0, 5, 5, [1, 2, 4], [tile(1, 2), tile(2, 3), tile(4, 5)])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(("map_id", "si", "x", "y", "versions", "log"), row))])
    fold = lambda: [(r["zoom"], r["n"], r["places"]) for b in C._apply_log(iter([batch])) for r in b.to_pylist()]
    assert fold() == [(0, 5, 10 + 20)]
    monkeypatch.setattr(verbs, "decode", lambda patch, reference: reference)
    assert fold() == [(0, 2, 1 + 2)]
