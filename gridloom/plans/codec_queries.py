"""The byte formats at table scale: every delivered tile is encoded, patched and read again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import relations as R
from gridloom.codec.dump import read_dump, tile_lines
from gridloom.codec.patch import EMPTY, WATER, decode, encode
from gridloom.codec.tile import normalised, read_blob, read_tile, write_blob, write_tile, zoom_bytes
from gridloom.operators.snapshots import snapshot_steps
from gridloom.plans.map_queries import _with
from gridloom.verbs import folded_tile, id_map, zoom_patches

_PLACE = "map_id string, version int, si int, x int, y int"


def _features(rows: list[dict] | None, kind: str, ids: dict[str, int]) -> list[tuple[int, dict]]:
    """(zoom row, feature) as the codec takes them; numbers the format cannot leave out default to 0."""
    out = []
    for r in rows or []:
        f = {k: r.get(k) for k in ("lat", "lon", "layer", "house_number", "elevation", "reference", "label_lat", "label_lon", "sub_tile_bitmap", "blocks")}
        f |= {"name": r["feat_name"], "encoding": bool(r.get("double_delta")), "tags": [ids[t] for t in r["tags"] or []]}
        f |= {k: f[k] or 0 for k in (("lat", "lon", "layer") if kind == "poi" else ("layer", "sub_tile_bitmap"))}
        if kind == "poi":
            f = {k: f[k] for k in ("lat", "lon", "layer", "tags", "name", "house_number", "elevation")}
        else:
            f = {k: v for k, v in f.items() if k not in ("lat", "lon", "elevation")}
            f |= {"blocks": f["blocks"] or [], "explicit_num_blocks": len(f["blocks"] or []) != 1}
            if f["label_lat"] is None or f["label_lon"] is None:
                f |= {"label_lat": None, "label_lon": None}
        out.append((r["zi_index"] or 0, f))
    return out


def _dictionary(*groups: list[dict] | None) -> dict[str, int]:
    tags = sorted({t for g in groups for r in g or [] for t in r["tags"] or []})
    return {t: i for i, t in enumerate(tags)}


def _by_zoom(features: list[tuple[int, dict]], zooms: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(zooms)]
    for z, f in features:
        out[z].append(f)
    return out


def _rows(batch: pa.RecordBatch, results: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*results)) if results else [[], [], []]
    return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_())], names=["map_id", "version", "si", "x", "y", "n_pois", "n_ways", "same"])


def _tile_round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        results = []
        for x, y, pois, ways in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6))):
            ids = _dictionary(pois, ways)
            p, w = _features(pois, "poi", ids), _features(ways, "way", ids)
            zooms = 1 + max((z for z, _ in p + w), default=0)
            rows = _by_zoom(p, zooms), _by_zoom(w, zooms)
            body = write_tile(*rows, x, y, debug=True)
            same = read_tile(body, x, y, zooms, debug=True, check=True) == rows
            same &= [read_blob(z) for z in zoom_bytes(body, x, y, zooms, debug=True)] == list(zip(*rows))
            results.append((len(p), len(w), same))
        yield _rows(b, results)


def _patch_round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        results = []
        for pois, ways, pois2, ways2 in zip(*(b.column(i).to_pylist() for i in (5, 6, 7, 8))):
            ids = _dictionary(pois, ways, pois2, ways2)
            blob = lambda p, w: write_blob(*normalised([f for _, f in _features(p, "poi", ids)], [f for _, f in _features(w, "way", ids)]))  # noqa: B023, E731
            old, new = blob(pois, ways), blob(pois2, ways2)
            results.append((len(pois2 or []), len(ways2 or []), decode(encode(new, old), old) == new))
        yield _rows(b, results)


def _dump_round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        results = []
        for si, x, y, pois, ways in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
            ids = _dictionary(pois, ways)
            names = {i: t for t, i in ids.items()}
            given = [{**f, "kind": k, "zoom": z, "tags": [names[t] for t in f["tags"]]} for k, rows in (("poi", pois), ("way", ways)) for z, f in _features(rows, k, ids)]
            _, tiles = read_dump("\n".join(tile_lines(si, x, y, False, given, 0)).split("\n"))
            read = tiles[0]["features"]
            same = len(read) == len(given) and all(
                r.get("zi_index") == f["zoom"] and all(r.get(k) == v for k, v in f.items() if k not in ("zoom", "explicit_num_blocks")) for r, f in zip(read, given)
            )
            results.append((len(pois or []), len(ways or []), same))
        yield _rows(b, results)


def codec_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.snapshot_tiles(spark, sf_dir).select("map_id", "version", "si", "x", "y", "pois", "ways")
    return t.mapInArrow(_tile_round_trip, _PLACE + ", n_pois int, n_ways int, same boolean")


def codec_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.snapshot_tiles(spark, sf_dir).select("map_id", "version", "si", "x", "y", "pois", "ways")
    return t.mapInArrow(_dump_round_trip, _PLACE + ", n_pois int, n_ways int, same boolean")


def codec_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["map_id", "version", "si", "x", "y"]
    old = R.snapshot_tiles(spark, sf_dir).select(*key, "pois", "ways")
    new = R.snapshot_tiles(spark, sf_dir, "tile_snapshot_copy").select(*key, F.col("pois").alias("pois2"), F.col("ways").alias("ways2"))
    return old.join(new, key).select(*key, "pois", "ways", "pois2", "ways2").mapInArrow(_patch_round_trip, _PLACE + ", n_pois int, n_ways int, same boolean")


# -- change logs: encoded between versions, folded onto the first one ---------------------------------

_FOLDED = "map_id string, si int, x int, y int, zoom int, kind string, n bigint, n_tags bigint, layers bigint, places bigint, n_nodes bigint, n_named bigint"


def _versions_of(present: dict[int, dict], versions: list[int], x: int, y: int) -> tuple[list[tuple], list[tuple[list, list]]]:
    """Each version as the fold takes it, under a dictionary of its own, and its zoom rows.

    Where the tile is not delivered the grid of the version does not hold it.
    """
    zooms = 1 + max((e["zi_index"] or 0 for r in present.values() for k in ("pois", "ways") for e in r[k] or []), default=0)
    vs, rows = [], []
    for v in versions:
        r = present.get(v)
        ids = [_dictionary(r and r[k]) for k in ("pois", "ways")]
        grid = (x, y, x, y) if r else (x + 1, y + 1, x + 1, y + 1)
        vs.append((list(ids[0]), list(ids[1]), {0: (0, 0, zooms - 1, grid)}, False))
        rows.append([_by_zoom(_features(r and r[k], kind, i), zooms) for k, kind, i in zip(("pois", "ways"), ("poi", "way"), ids)])
    return vs, rows


def _apply_log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """map_id, si, x, y, versions, log (version, is_water, pois, ways) -> what the folded tile holds."""
    names = [c.strip().split(" ")[0] for c in _FOLDED.split(",")]
    types = [pa.string(), *[pa.int32()] * 4, pa.string(), *[pa.int64()] * 6]
    for b in batches:
        out: list[tuple] = []
        for map_id, si, x, y, versions, log in zip(*(c.to_pylist() for c in b.columns)):
            vs, rows = _versions_of({r["version"]: r for r in log}, versions, x, y)
            water = {r["version"]: bool(r["is_water"]) for r in log}
            moves = [[id_map(p[i], q[i]) for i in (0, 1)] for p, q in zip(vs, vs[1:])]
            steps = {}
            for i in range(1, len(vs)):
                if versions[i] not in water:
                    continue  # outside the grid of this version: the log has no record
                here = versions[i - 1] in water
                before = dict(enumerate(zip(*rows[i - 1]))) if here else {}
                after = dict(enumerate(zip(*rows[i])))
                patches = zoom_patches(before, after, moves[i - 1], range(len(after)))
                filled = any(p or w for p, w in after.values())
                if patches or not here or water[versions[i]] != water[versions[i - 1]]:
                    steps[i] = (WATER if water[versions[i]] else 0) | (0 if filled else EMPTY), patches if filled else {}
            body = write_tile(*rows[0], x, y) if versions[0] in water else None
            _, parts = folded_tile(vs, moves, 0, x, y, water.get(versions[0], False), body, steps)
            for zoom, features in enumerate(parts or []):
                for kind, fs in zip(("poi", "way"), features):
                    if fs:
                        places = sum(f["lat"] + f["lon"] for f in fs) if kind == "poi" else 0
                        nodes = sum(len(s) for f in fs for segments in f["blocks"] for s in segments) if kind == "way" else 0
                        out.append((map_id, si, x, y, zoom, kind, len(fs), sum(len(f["tags"]) for f in fs), sum(f["layer"] for f in fs), places, nodes, sum(f["name"] is not None for f in fs)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), types)], names=names)


def apply_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first copy with the patches to the second one applied is the second copy."""
    sides = [R.snapshot_tiles(spark, sf_dir, t).withColumn("side", F.lit(i)) for i, t in enumerate(("tile_snapshot", "tile_snapshot_copy"))]
    both = sides[0].unionByName(sides[1]).withColumn("map_id", F.concat_ws("#", "map_id", "version"))
    log = both.groupBy("map_id", "si", "x", "y").agg(F.collect_list(F.struct(F.col("side").alias("version"), "is_water", "pois", "ways")).alias("log"))  # two rows at most
    return log.select("map_id", "si", "x", "y", F.array(F.lit(0), F.lit(1)).alias("versions"), "log").mapInArrow(_apply_log, _FOLDED)


def apply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each map's first delivery with the patches of all later steps applied is its last delivery."""
    t = R.snapshot_tiles(spark, sf_dir)
    versions = snapshot_steps(t, ["map_id"], "version").groupBy("map_id").agg(F.array_sort(F.collect_list("version")).alias("versions"))
    log = t.groupBy("map_id", "si", "x", "y").agg(F.collect_list(F.struct("version", "is_water", "pois", "ways")).alias("log"))  # a row per delivery
    return log.join(versions, "map_id").select("map_id", "si", "x", "y", "versions", "log").mapInArrow(_apply_log, _FOLDED)


_FOLDED_SQL = """count(*)::bigint n, sum(coalesce(len(v.tags), 0))::bigint n_tags, sum(coalesce(v.layer, 0))::bigint layers, sum(coalesce(v.lat, 0) + coalesce(v.lon, 0))::bigint places,
 sum(coalesce(len(flatten(flatten(v.blocks))), 0))::bigint n_nodes, count(v.name)::bigint n_named from"""
_ALL = _with("t") + "select map_id, version, si, x, y, coalesce(len(pois), 0)::int n_pois, coalesce(len(ways), 0)::int n_ways, true same from t"
QUERIES = {"codec_tiles": codec_tiles, "codec_dump": codec_dump, "codec_patches": codec_patches, "apply_single": apply_single, "apply_chain": apply_chain}
ORACLES = {
    "codec_tiles": _ALL,
    "codec_dump": _ALL,
    "codec_patches": _with("t tc")
    + """select b.map_id, b.version, b.si, b.x, b.y, coalesce(len(b.pois), 0)::int n_pois, coalesce(len(b.ways), 0)::int n_ways, true same
 from t a join tc b on a.map_id = b.map_id and a.version = b.version and a.si = b.si and a.x = b.x and a.y = b.y""",
    "apply_single": _with("ec") + f"select map_id || '#' || version as map_id, si, x, y, zoom, kind, {_FOLDED_SQL} ec group by all",
    "apply_chain": _with("e") + f"""select e.map_id, si, x, y, zoom, kind, {_FOLDED_SQL} e
 join (select map_id, max(version) version from t group by map_id) m on e.map_id = m.map_id and e.version = m.version group by all""",
}
