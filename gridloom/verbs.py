"""What one does with map files: each verb is a Spark plan between the ``tilemap`` source and the file sink."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.codec import dump as text
from gridloom.codec import fingerprint
from gridloom.codec.binary import FormatError
from gridloom.codec.header import grid_of
from gridloom.codec.patch import EMPTY, WATER, decode, encode, patch_records, read_patch_header, write_patch_file
from gridloom.codec.tile import normalised, read_blob, read_tile, remapped, stored_way_offset, tile_violations, write_blob, write_tile
from gridloom.operators import changes, merging, tagging
from gridloom.operators import features as fe
from gridloom.operators import headers as he
from gridloom.session import cut_lineage
from gridloom.sources.mapfile import encode_tiles, guard, tile_batch, write_map_file
from gridloom.sources.tilemap import STRETCH, files_of, index_entries, load_header, map_id_of, map_ids, read_part


@dataclass
class Maps:
    """The relations of one or more map files."""

    header: DataFrame
    tile: DataFrame
    raw: DataFrame
    feature: DataFrame


def read_map(spark: SparkSession, path: str | Sequence[str]) -> Maps:
    path = path if isinstance(path, str) else ",".join(path)
    parts = {p: read_part(spark, path, p) for p in ("header", "tile_index", "tile_raw", "feature")}
    return Maps(parts["header"], parts["tile_index"], parts["tile_raw"], parts["feature"])


def _now() -> int:
    return int(time.time() * 1000)


def _renamed(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("map_id", F.lit(name))


# -- merge, crop, edit -----------------------------------------------------------------------------


#: Tags a dictionary may hold: its length is a 16-bit number in the file.
MOST_TAGS = 65_535


def ranked_tags(features: DataFrame) -> dict[str, list[str]]:
    """poi_tags and way_tags for a file, most frequent first; too many of them are an error."""
    ranked = tagging.ranked_dictionary(features).where(F.col("tag_id") <= MOST_TAGS).orderBy("kind", "tag_id").select("kind", "tag").collect()
    tags = {f"{k}_tags": [r.tag for r in ranked if r.kind == k] for k in ("poi", "way")}
    for name, listed in tags.items():
        if len(listed) > MOST_TAGS:
            raise ValueError(f"{name}: a file holds at most {MOST_TAGS} different tags")
    return tags


def merge(spark: SparkSession, inputs: Sequence[str], out: str, tile: tuple[int, int, int] | None = None, force: bool = False) -> dict:
    """All features of all inputs in one file, under a dictionary ranked by use.

    Header fields and zoom intervals come from the first input, the box is the union of the inputs
    with data, a tile is water if every input covering it says so. Inputs pair their intervals by base
    zoom. For an interval of the result that an input lacks, the input's interval that contains its base
    zoom gives the tiles of the same coordinates, cut to the zoom levels both have; grids of different
    base zooms differ, so only tiles of such a map that lie in the result's grid take part.
    """
    if len(inputs) < 2:
        raise ValueError("merge needs at least two maps")
    guard(out, force)
    if len(set(inputs)) < len(inputs):
        raise ValueError("an input is named twice")
    heads = [load_header(p) for p in inputs]
    ids = map_ids(list(inputs))
    first = heads[0]
    pairs = []  # (map, its si, si of the result, minimum zoom, maximum zoom)
    for p, h in zip(inputs, heads):
        for z in h["zoom_intervals"]:
            pairs += [(ids[p], z["si"], f["si"], f["min"], f["max"]) for f in first["zoom_intervals"] if _source_interval(h, f["base"]) == z["si"]]
    m = read_map(spark, inputs)
    to = spark.createDataFrame(pairs, "map_id string, si int, to_si int, low int, high int")  # intervals of the inputs
    features = m.feature.join(F.broadcast(to), ["map_id", "si"]).where("zoom between low and high").withColumn("si", F.col("to_si"))
    index = m.tile.join(F.broadcast(to), ["map_id", "si"]).withColumn("si", F.col("to_si"))
    if tile is not None:
        s, x, y = tile
        features, index = (d.where((F.col("si") == s) & (F.col("x") == x) & (F.col("y") == y)) for d in (features, index))
    with_data = {r.map_id for r in index.where("length > 0").select("map_id").distinct().collect()}  # at most one row per input
    boxed = [h for p, h in zip(inputs, heads) if ids[p] in with_data] or heads
    header = {**first, "creation_date": _now()}
    header |= {k: min(h[k] for h in boxed) for k in ("min_lat", "min_lon")} | {k: max(h[k] for h in boxed) for k in ("max_lat", "max_lon")}
    header |= ranked_tags(features)
    bodies = encode_tiles(features, header)
    water = merging.merged_water(index)
    tiles = water.join(bodies, ["si", "x", "y"], "full_outer").select("si", "x", "y", "is_water", "bytes")
    return write_map_file(header, tiles, out, force)


def _source_interval(h: dict, base: int) -> int | None:
    """The first interval of a map with this base zoom, else the first one whose levels contain it."""
    same = [z["si"] for z in h["zoom_intervals"] if z["base"] == base]
    around = [z["si"] for z in h["zoom_intervals"] if z["min"] <= base <= z["max"]]
    return (same or around or [None])[0]


def _box_of(bbox: Sequence[float] | None, center: Sequence[float] | None, distance: float | None, spark: SparkSession) -> tuple[int, int, int, int]:
    """The region in micro-degrees, from a box (min_lon, min_lat, max_lon, max_lat) or a centre (lat, lon) and kilometres."""
    from gridloom.functions import mercator as m

    if (bbox is None) == (center is None) or (center is None) != (distance is None):
        raise ValueError("give either a box or a centre with a distance")
    if bbox is None:
        r = spark.range(1).select(*(c.alias(k) for k, c in m.center_bbox(*map(float, (center[0], center[1], distance))).items())).first()
        bbox = (r.min_lon, r.min_lat, r.max_lon, r.max_lat)
    return tuple(int(v * 1_000_000) for v in (bbox[1], bbox[0], bbox[3], bbox[2]))


def _cropped(path: str, box: tuple[int, int, int, int]) -> dict:
    h = load_header(path)
    h |= {k: max(h[k], v) for k, v in zip(("min_lat", "min_lon"), box[:2])} | {k: min(h[k], v) for k, v in zip(("max_lat", "max_lon"), box[2:])}
    if h["min_lat"] > h["max_lat"] or h["min_lon"] > h["max_lon"]:
        raise ValueError("the region does not touch the map")
    return h


def crop(spark: SparkSession, path: str, out: str, bbox=None, center=None, distance=None, force: bool = False) -> dict:
    """The tiles that touch the region, as they are; tiles outside the source would be water."""
    header = {**_cropped(path, _box_of(bbox, center, distance, spark)), "creation_date": _now()}
    return write_map_file(header, read_part(spark, path, "tile_raw"), out, force, default_water=True)


def estimate_size(spark: SparkSession, path: str, bbox=None, center=None, distance=None) -> dict:
    """Bytes of the cropped file: what the header's size field says it has, and with the 24 bytes before it."""
    from gridloom.codec.header import write_header
    from gridloom.operators import tiles

    h = _cropped(path, _box_of(bbox, center, distance, spark))
    grid = []
    for z in h["zoom_intervals"]:
        x0, y0, x1, y1 = grid_of(h, z)
        grid.append((map_id_of(path), z["si"], x0, y0, x1, y1, (x1 - x0 + 1) * (y1 - y0 + 1), h["has_debug"]))
    g = spark.createDataFrame(grid, "map_id string, si int, x0 int, y0 int, x1 int, y1 int, n_tiles bigint, has_debug boolean")
    r = tiles.size_estimate(read_part(spark, path, "tile_index"), g).first()
    whole = len(write_header(h)) + r.data_bytes + r.index_bytes
    return {"bytes": whole - 24, "file_bytes": whole, "n_tiles": r.n_tiles, "data_bytes": r.data_bytes}


def edit(spark: SparkSession, path: str, out: str, comment: str | None = None, timestamp: int | None = None, force: bool = False) -> dict:
    """Another comment and / or creation date; bodies are copied."""
    if comment is None and timestamp is None:
        raise ValueError("nothing to edit: give a comment or a timestamp")
    h = load_header(path)
    h |= ({} if comment is None else {"comment": comment}) | ({} if timestamp is None else {"creation_date": timestamp})
    return write_map_file(h, read_part(spark, path, "tile_raw"), out, force)


# -- comparisons and statistics ---------------------------------------------------------------------


def diff(spark: SparkSession, old: str, new: str, ignore_comment: bool = False, ignore_timestamp: bool = False, strict: bool = False) -> dict[str, DataFrame]:
    """``header``, ``tiles`` and ``elements``: what differs. With other zoom intervals only headers compare."""
    a, b = (read_map(spark, p) for p in (old, new))
    header = he.header_diff(_renamed(a.header, "map"), _renamed(b.header, "map"), ignore_comment, ignore_timestamp)
    shape = [[(z["base"], z["min"], z["max"]) for z in load_header(p)["zoom_intervals"]] for p in (old, new)]
    if shape[0] != shape[1]:
        intervals = spark.createDataFrame([("map", "zoom_intervals", str(shape[0]), str(shape[1]))], header.schema)
        return {"header": header.unionByName(intervals)}
    fa, fb = _renamed(a.feature, "map"), _renamed(b.feature, "map")
    here = lambda m: _renamed(m.tile, "map").where("length > 0 or is_water")
    return {
        "header": header,
        "tiles": changes.tile_diff(here(a), here(b), fa, fb),
        "elements": fe.bag_difference(fa, fb, strict_tags=strict),
    }


def tags(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per kind and tag over all maps: uses, lowest zoom, and uses per zoom level."""
    m = read_map(spark, paths)
    counts = tagging.tag_counts(m.feature, ())
    zooms = [r.zoom for r in counts.select("zoom").distinct().orderBy("zoom").collect()]  # zoom levels are below 256
    stats = tagging.tag_stats(counts, tagging.dictionary(m.header), ())
    return stats.join(tagging.zoom_pivot(counts, zooms), ["kind", "tag"], "left").fillna(0).orderBy("kind", "tag")


def tag_report(spark: SparkSession, paths: str | Sequence[str], repeat: int = 20) -> Iterator[str]:
    """The statistics as lines: points, then ways, by tag; counts rounded down to one significant digit, the heading again every ``repeat`` rows."""
    found = tags(spark, paths)
    zooms = [c for c in found.columns if c.startswith("z")]
    shown = found.select("kind", "tag", "appear", *(tagging.rounded(F.col(c)).alias(c) for c in ("count", *zooms))).orderBy("kind", "tag")
    heading = "\t".join(["tag", "appear", "count", *zooms])
    kind, at = None, 0
    for r in shown.toLocalIterator(prefetchPartitions=True):
        if r.kind != kind:
            kind, at = r.kind, 0
            yield f"# {kind}"
        if at % repeat == 0:
            yield heading
        at += 1
        yield "\t".join([r.tag, "-" if r.appear == tagging.UNUSED else str(r.appear), str(r["count"]), *(str(r[z] or "") for z in zooms)])


def semantic_hash(spark: SparkSession, path: str, ignore_comment: bool = False, ignore_timestamp: bool = False) -> str:
    """Equal for maps that say the same, whatever their dictionaries and orders of tags and features."""
    m = read_map(spark, path)
    hashed = _renamed(m.feature, "map").select(*fe.ROW, fe.portable_hash(fe.value_key()).alias("h"))
    digests = fe.tile_digests(hashed, fe.ROW)
    water = _renamed(m.tile, "map").where("is_water").select("map_id", "si", "x", "y", F.lit(-1).alias("zoom"), F.lit("water").alias("kind"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("digest"))
    whole = fe.map_digest(digests.unionByName(water)).first()
    h = load_header(path)
    skip = {"comment"} if ignore_comment else set()
    skip |= {"creation_date"} if ignore_timestamp else set()
    fields = [h[k] for k in he.COMPARED if k not in skip] + [(z["base"], z["min"], z["max"]) for z in h["zoom_intervals"]]
    import hashlib

    return hashlib.sha256(repr((fields, whole.digest if whole else "")).encode()).hexdigest()


def file_digest(spark: SparkSession, path: str, ignore_comment: bool = False, ignore_timestamp: bool = False) -> str:
    """The published digest of a file (see codec/fingerprint.py). Maps with debug signatures have none.

    Tasks reduce each tile to two sums per zoom row; the driver folds these in (si, x, y) order.
    """
    import hashlib
    import struct

    h = load_header(path)
    if h["has_debug"]:
        raise ValueError("maps with debug signatures have no digest")
    zooms = {z["si"]: z["max"] - z["min"] + 1 for z in h["zoom_intervals"]}
    names = h["poi_tags"], h["way_tags"]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = [fingerprint.TagHashes(n) for n in names]
        for b in batches:
            rows = []
            for si, x, y, water, body in zip(*(c.to_pylist() for c in b.columns)):
                sums = fingerprint.zoom_sums(*read_tile(body, x, y, zooms[si], light=True), *tags) if body else b""
                rows.append(struct.pack("<IIIB", si, x, y, bool(water)) + sums)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, pa.binary())], names=["si", "x", "y", "part"])

    parts = read_part(spark, path, "tile_raw").select("si", "x", "y", "is_water", "bytes").mapInArrow(reduce, "si int, x int, y int, part binary")
    sha = hashlib.sha256(fingerprint.header_bytes(h, ignore_comment, ignore_timestamp))
    for r in parts.orderBy("si", "x", "y").select("part").toLocalIterator(prefetchPartitions=True):
        sha.update(r.part)
    return sha.hexdigest()


def validate(spark: SparkSession, path: str) -> DataFrame:
    """One row per violation; header rules are found on the driver, index and tile rules by the tasks.

    The index is checked stretch by stretch, each of which tells its first fault. The tiles of an interval
    whose index is broken cannot be found, so those are read only where the index holds.
    """
    rows, heads, stretches = [], {}, []
    for p in files_of(path):
        try:
            heads[p] = h = load_header(p)
            for z in h["zoom_intervals"]:
                x0, y0, x1, y1 = grid_of(h, z)
                n = (x1 - x0 + 1) * (y1 - y0 + 1)
                stretches += [(p, z["si"], i, min(i + STRETCH, n)) for i in range(0, n, STRETCH)]
        except FormatError as e:
            heads.pop(p, None)
            rows.append((map_id_of(p), e.rule, None, None, None, str(e)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, si, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    h = load_header(p)
                    for _ in index_entries(p, h, h["zoom_intervals"][si], start, stop):
                        pass
                except FormatError as e:
                    out.append((map_id_of(p), e.rule, si, None, None, str(e), p))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    schema = pa.schema([(n, pa.int32() if n in ("si", "x", "y") else pa.string()) for n in ("map_id", "rule", "si", "x", "y", "detail", "path")])
    stretch = spark.createDataFrame(stretches, "path string, si int, start bigint, stop bigint").repartition(max(1, min(len(stretches), 4 * spark.sparkContext.defaultParallelism)))
    index = cut_lineage(stretch.mapInArrow(walk, schemas.VIOLATION + ", path string"))
    broken = {(r.path, r.si) for r in index.select("path", "si").distinct().collect()}  # at most one per interval of a file
    found = spark.createDataFrame(rows, schemas.VIOLATION).unionByName(index.drop("path"))
    checked = [(p, h) for p, h in heads.items() if not any((p, z["si"]) in broken for z in h["zoom_intervals"])]
    for p, h in checked:
        facts = ({z["si"]: z["max"] - z["min"] + 1 for z in h["zoom_intervals"]}, h["has_debug"], len(h["poi_tags"]), len(h["way_tags"]))

        def check(batches: Iterator[pa.RecordBatch], facts=facts) -> Iterator[pa.RecordBatch]:
            zooms, debug, n_poi, n_way = facts
            for b in batches:
                out = [(m, rule, si, x, y, detail) for m, si, x, y, body in zip(*(c.to_pylist() for c in b.columns)) for rule, detail in tile_violations(body, x, y, zooms[si], debug, n_poi, n_way)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["map_id", "rule", "si", "x", "y", "detail"])

        raw = read_part(spark, p, "tile_raw").where("length > 0").select("map_id", "si", "x", "y", "bytes")
        found = found.unionByName(raw.mapInArrow(check, schemas.VIOLATION))
    return found


# -- dump and load ----------------------------------------------------------------------------------


def dump(spark: SparkSession, path: str, header: bool = False, all: bool = False, tile: tuple[int, int, int] | None = None) -> Iterator[str]:
    """Lines of text: the header, every tile, or one tile. Tiles come column by column."""
    h = load_header(path)
    if header or all:
        yield from text.header_lines(h)
    if not all and tile is None:
        return
    raw = read_part(spark, path, "tile_raw")
    if tile is not None:
        raw = raw.where((F.col("si") == tile[0]) & (F.col("x") == tile[1]) & (F.col("y") == tile[2]))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for si, x, y, water, body in zip(*(c.to_pylist() for c in b.columns)):
                z = h["zoom_intervals"][si]
                rows, offset = None, 0
                if body:
                    offset = stored_way_offset(body, z["max"] - z["min"] + 1, h["has_debug"])
                    pois, ways = read_tile(body, x, y, z["max"] - z["min"] + 1, h["has_debug"])
                    rows = [{**f, "kind": k, "zoom": z["min"] + zi, "tags": [h[f"{k}_tags"][t] for t in f["tags"]]} for k, part in (("poi", pois), ("way", ways)) for zi, row in enumerate(part) for f in row]
                made.append("\n".join(text.tile_lines(si, x, y, bool(water), rows, z["min"], offset)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.string())], names=["si", "x", "y", "text"])

    out = raw.select("si", "x", "y", "is_water", "bytes").mapInArrow(lines, "si int, x int, y int, text string")
    for r in out.orderBy("si", "x", "y").select("text").toLocalIterator():
        yield from r.text.split("\n")


def load(spark: SparkSession, path: str, out: str, force: bool = False) -> dict:
    """A map file from its dump. Sections of tiles are parsed and encoded by tasks."""
    guard(out, force)
    head = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.startswith("[[tiles]]"):
                break
            head.append(line)
    h, _ = text.read_dump(head)
    h["header_size"] = 0
    ids = {k: {t: i for i, t in reversed(list(enumerate(h[f"{k}_tags"])))} for k in ("poi", "way")}
    sections = spark.read.option("lineSep", "[[tiles]]\n").text(path).withColumnRenamed("value", "section").where("section like 'id = %'")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for section in b.column(0).to_pylist():
                _, tiles = text.read_dump(["[[tiles]]", *section.split("\n")])
                t = tiles[0]
                z = h["zoom_intervals"][t["si"]]
                body = None
                if t["features"]:
                    parts = {k: [[] for _ in range(z["max"] - z["min"] + 1)] for k in ("poi", "way")}
                    blank = dict.fromkeys(("name", "house_number", "elevation", "reference", "label_lat", "label_lon", "explicit_num_blocks"))
                    for f in t["features"]:
                        known = [ids[f["kind"]][s] for s in f["tags"] if s in ids[f["kind"]]]
                        parts[f["kind"]][f["zi_index"]].append({**blank, **f, "tags": sorted(known)})
                    body = write_tile(parts["poi"], parts["way"], t["x"], t["y"], h["has_debug"])
                made.append((t["si"], t["x"], t["y"], t["is_water"], body))
            yield tile_batch(made)

    tiles = sections.mapInArrow(parse, "si int, x int, y int, is_water boolean, bytes binary")
    return write_map_file(h, tiles, out, force)


# -- delta and apply --------------------------------------------------------------------------------


def id_map(old: list[str], new: list[str]) -> list[int | None]:
    at = {t: i for i, t in enumerate(new)}
    return [at.get(t) for t in old]


def zoom_patches(before: dict[int, tuple[list, list]], after: dict[int, tuple[list, list]], moves: Sequence[list[int | None]], zooms: Sequence[int]) -> dict[int, bytes]:
    """The patch of each zoom row that differs, against its former state under the new dictionaries."""
    patches = {}
    for zoom in zooms:
        p, w = before.get(zoom, ([], []))
        reference = write_blob(*normalised(remapped(p, moves[0]), remapped(w, moves[1])))
        target = write_blob(*normalised(*after.get(zoom, ([], []))))
        if reference != target:
            patches[zoom] = encode(target, reference)
    return patches


def delta(spark: SparkSession, old: str, new: str, out: str, force: bool = False) -> int:
    """The change log from old to new; returns the number of changed tiles.

    Tiles pair by interval and coordinates over the new map's grid. Identical bytes under an identical
    dictionary are dropped in the join, so only changed tiles are decoded.
    """
    guard(out, force)
    h1, h2 = load_header(old), load_header(new)
    maps = {k: id_map(h1[f"{k}_tags"], h2[f"{k}_tags"]) for k in ("poi", "way")}
    same_ids = all(h1[f"{k}_tags"] == h2[f"{k}_tags"] for k in maps) and h1["has_debug"] == h2["has_debug"]
    shapes = [{z["si"]: (z["base"], z["min"], z["max"]) for z in h["zoom_intervals"]} for h in (h1, h2)]
    a = read_part(spark, old, "tile_raw").select("si", "x", "y", F.col("is_water").alias("w1"), F.col("bytes").alias("b1"))
    b = read_part(spark, new, "tile_raw").select("si", "x", "y", F.col("is_water").alias("w2"), F.col("bytes").alias("b2"))
    pairs = a.join(b, ["si", "x", "y"], "right_outer")
    if same_ids and shapes[0] == shapes[1]:
        pairs = pairs.where(~(F.col("b1").eqNullSafe(F.col("b2")) & F.col("w1").eqNullSafe(F.col("w2"))))

    def rows_of(body, si, x, y, h, shape) -> dict[int, tuple[list, list]]:
        if body is None or si not in shape:
            return {}
        _, low, high = shape[si]
        pois, ways = read_tile(body, x, y, high - low + 1, h["has_debug"])
        return {low + i: pw for i, pw in enumerate(zip(pois, ways))}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for si, x, y, w1, b1, w2, b2 in zip(*(c.to_pylist() for c in batch.columns)):
                base, low, high = shapes[1][si]
                paired = si in shapes[0] and shapes[0][si][0] == base
                before = rows_of(b1, si, x, y, h1, shapes[0]) if paired else {}
                after = rows_of(b2, si, x, y, h2, shapes[1])
                filled = any(p or w for p, w in after.values())
                patches = {z - low: p for z, p in zoom_patches(before, after, (maps["poi"], maps["way"]), range(low, high + 1)).items()}
                if not patches and bool(w1) == bool(w2):
                    continue
                flags = (WATER if w2 else 0) | (0 if filled else EMPTY)
                made.append({"si": si, "x": x, "y": y, "flags": flags, "patches": [] if flags & EMPTY else list(patches.items())})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    arrow = pa.schema([("si", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("flags", pa.int32()), ("patches", pa.map_(pa.int32(), pa.binary()))])
    made = pairs.select("si", "x", "y", "w1", "b1", "w2", "b2").mapInArrow(records, "si int, x int, y int, flags int, patches map<int, binary>")
    kept = [(r.si, r.x, r.y, r.flags, {k: bytes(v) for k, v in r.patches.items()}) for r in made.toLocalIterator()]  # the file's own content
    data = write_patch_file(h2, (h1["poi_tags"], h1["way_tags"]), kept)
    with open(out, "wb") as f:
        f.write(data)
    return len(kept)


def folded_tile(vs: list[tuple], moves: list, si: int, x: int, y: int, water: bool, body: bytes | None, steps: dict[int, tuple[int, dict[int, bytes]]]) -> tuple[bool, list[tuple[list, list]] | None]:
    """The water flag and zoom rows of a tile after all versions; no rows where the last one has no such interval.

    ``vs``: per version the two dictionaries, (base, min, max, grid) by interval and whether it is a
    debug map; ``moves``: the id maps from each version to the next; ``steps``: (flags, patches by zoom
    row) by version.
    """
    state: dict[int, tuple[list, list]] = {}
    shape = vs[0][2].get(si)
    if body is not None:
        _, low, high, _ = shape
        pois, ways = read_tile(body, x, y, high - low + 1, vs[0][3])
        state = {low + i: pw for i, pw in enumerate(zip(pois, ways))}
    for v in range(1, len(vs)):
        before, shape = shape, vs[v][2].get(si)
        if shape is None or before is None or before[0] != shape[0] or not (shape[3][0] <= x <= shape[3][2] and shape[3][1] <= y <= shape[3][3]):
            state, water = {}, False
        else:
            poi_ids, way_ids = moves[v - 1]
            state = {z: (remapped(p, poi_ids), remapped(w, way_ids)) for z, (p, w) in state.items() if shape[1] <= z <= shape[2]}
        if v in steps and shape is not None:
            flags, patches = steps[v]
            water = bool(flags & WATER)
            if flags & EMPTY:
                state = {}
            else:
                for zi, patch in patches.items():
                    zoom = shape[1] + zi
                    state[zoom] = read_blob(decode(patch, write_blob(*normalised(*state.get(zoom, ([], []))))))
    if shape is None:
        return False, None
    return bool(water), [state.get(z, ([], [])) for z in range(shape[1], shape[2] + 1)]


def apply(spark: SparkSession, base: str, deltas: Sequence[str], out: str, force: bool = False) -> dict:
    """The map after all change logs, folded per tile in one pass.

    A tile's state is independent of all others: records of all versions are grouped with the base
    tile and folded in order. Going from one version to the next drops features whose tags the next
    dictionary lacks, zoom rows its intervals lack, and tiles outside its grid.
    """
    guard(out, force)
    heads = [load_header(base)]
    for path in deltas:  # headers and dictionaries only: each tag diff needs the dictionary before it
        with open(path, "rb") as f:
            heads.append(read_patch_header(f, (heads[-1]["poi_tags"], heads[-1]["way_tags"])))
    versions = []
    for h in heads:
        grids = {z["si"]: (z["base"], z["min"], z["max"], grid_of(h, z)) for z in h["zoom_intervals"]}
        versions.append((h["poi_tags"], h["way_tags"], grids, h["has_debug"]))
    last = heads[-1]
    facts = spark.sparkContext.broadcast(versions)  # dictionaries and intervals: bounded by the format
    logs = spark.createDataFrame(list(enumerate(deltas, 1)), "version int, path string").repartition(max(1, len(deltas)), "version")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for version, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(path, "rb") as f:
                    stream = patch_records(f)
                    while some := list(islice(stream, 2000)):
                        rows = [{"si": si, "x": x, "y": y, "version": version, "flags": flags, "zi": zi, "patch": p} for si, x, y, flags, patches in some for zi, p in (patches.items() or [(None, None)])]
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([(n, pa.binary() if n == "patch" else pa.int32()) for n in ("si", "x", "y", "version", "flags", "zi", "patch")])
    change = logs.mapInArrow(records, "si int, x int, y int, version int, flags int, zi int, patch binary")
    # per tile at most one row per version and zoom row: bounded by the format and the length of the chain
    grouped = change.groupBy("si", "x", "y").agg(F.collect_list(F.struct("version", "flags", "zi", "patch")).alias("log"))
    raw = read_part(spark, base, "tile_raw").select("si", "x", "y", "is_water", "bytes")
    joined = raw.join(grouped, ["si", "x", "y"], "full_outer").select("si", "x", "y", "is_water", "bytes", "log")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vs = facts.value
        moves = [[id_map(a[i], b[i]) for i in (0, 1)] for a, b in zip(vs, vs[1:])]
        for batch in batches:
            made = []
            for si, x, y, water, body, log in zip(*(c.to_pylist() for c in batch.columns)):
                steps = {}
                for r in log or []:
                    flags, patches = steps.setdefault(r["version"], (r["flags"], {}))
                    if r["zi"] is not None:
                        patches[r["zi"]] = r["patch"]
                water, parts = folded_tile(vs, moves, si, x, y, water, body, steps)
                if parts is None:
                    continue
                filled = any(p or w for p, w in parts)
                made.append((si, x, y, bool(water), write_tile([p for p, _ in parts], [w for _, w in parts], x, y, vs[-1][3]) if filled else None))
            yield tile_batch(made)

    tiles = joined.mapInArrow(fold, "si int, x int, y int, is_water boolean, bytes binary")
    return write_map_file(last, tiles, out, force)
