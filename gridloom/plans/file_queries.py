"""Map, change-log and dump files at table scale: written by the verbs, read back by the sources.

The current version of all maps is merged into one file in the shared folder. What the sources read
from it is compared with the tables, so writer and reader are held against data, not each other.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import relations as R
from gridloom import verbs
from gridloom.operators import headers as HE
from gridloom.operators import merging
from gridloom.plans.map_queries import _with
from gridloom.session import ensure_checkpoint_dir
from gridloom.sources.mapfile import encode_tiles, write_map_file
from gridloom.sources.tilemap import read_part, register

#: base, lowest and highest zoom level of the intervals of the file, as all maps have them
INTERVALS = ((7, 0, 7), (12, 8, 12), (14, 13, 21))
_LOW = "element_at(array(" + ", ".join(str(low) for _, low, _ in INTERVALS) + "), si + 1)"


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    if not root.startswith("/"):
        raise ValueError("map files need a shared folder that is mounted as a path")
    folder = os.path.join("/" + root.lstrip("/"), f"files-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def _current(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The last delivery of each map."""
    t = R.snapshot_tiles(spark, d, name)
    last = t.groupBy("map_id").agg(F.max("version").alias("version"))
    return t.join(last, ["map_id", "version"], "left_semi")


def _features(tiles: DataFrame) -> DataFrame:
    """Features as a file holds them: absolute zoom levels, numbers the format cannot leave out as 0."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("layer", "sub_tile_bitmap")}
    zero |= {c: F.when(F.col("kind") == "poi", F.coalesce(c, F.lit(0))) for c in ("lat", "lon")}
    label = F.col("label_lat").isNotNull() & F.col("label_lon").isNotNull()
    zero |= {c: F.when(label, F.col(c)) for c in ("label_lat", "label_lon")}
    return R.snapshot_features(tiles).withColumns(zero | {"encoding": F.coalesce("encoding", F.lit(False)), "zoom": F.col("zoom") + F.expr(_LOW)})


def _write(spark: SparkSession, d: str, folder: str, name: str = "tile_snapshot") -> str:
    tiles = _current(spark, d, name)
    features = _features(tiles)
    box = HE.bbox_union(R.headers(spark, d)).first()
    header = {
        "file_version": 5, "file_size": 0, "creation_date": 1700000000000, "tile_size": 256, "projection": "Mercator", "has_debug": False,
        **{c: box[c] for c in HE.BBOX}, "start_lat": -1_500_000, "start_lon": 1_500_000, "start_zoom": 9, "language": "en", "comment": "all maps", "created_by": "gridloom",
        "zoom_intervals": [{"si": i, "base": b, "min": lo, "max": hi, "pos": 0, "size": 0} for i, (b, lo, hi) in enumerate(INTERVALS)], **verbs.ranked_tags(features),
    }
    water = merging.merged_water(tiles.select("map_id", "si", "x", "y", "is_water"))
    rows = water.join(encode_tiles(features, header), ["si", "x", "y"], "full_outer").select("si", "x", "y", "is_water", "bytes")
    path = os.path.join(folder, f"{name}.map")
    write_map_file(header, rows, path)
    return path


def _summed(features: DataFrame) -> DataFrame:
    nodes = F.aggregate(F.flatten(F.flatten("blocks")), F.lit(0), lambda a, _: a + 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return features.groupBy("si", "x", "y", "zoom", "kind").agg(
        F.count("*").alias("n"), total(F.size("tags")).alias("n_tags"), total("layer").alias("layers"), total(F.col("lat") + F.col("lon")).alias("places"),
        total(nodes).alias("n_nodes"), F.count("name").alias("n_named"),
    )


def file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = read_part(spark, _write(spark, sf_dir, _folder(spark)), "header")
    return h.select("file_version", "creation_date", *HE.BBOX, "tile_size", "projection", "has_debug", "start_zoom", "language", "comment", F.size("poi_tags").alias("n_poi_tags"), F.size("way_tags").alias("n_way_tags"), F.size("zoom_intervals").alias("n_intervals"))


def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionaries of the file, ranked by use."""
    h = read_part(spark, _write(spark, sf_dir, _folder(spark)), "header")
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_tags").alias("tags")) for k in ("poi", "way")))
    return h.select(F.inline(both)).select("kind", F.posexplode("tags").alias("tag_id", "tag"))


def file_tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the index that are water or have a body."""
    t = read_part(spark, _write(spark, sf_dir, _folder(spark)), "tile_index")
    return t.where("length > 0 or is_water").select("si", "x", "y", "is_water", (F.col("length") > 0).alias("has_data"))


def file_tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile by its coordinates: the filters reach the source, which reads one stretch of the index."""
    t = read_part(spark, _write(spark, sf_dir, _folder(spark)), "tile_raw")
    t = t.where("si = 2 and x = 8256 and y = 8256")
    return t.select("si", "x", "y", (F.length("bytes") == F.col("length")).alias("whole"))


def file_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(read_part(spark, _write(spark, sf_dir, _folder(spark)), "feature"))


def _delta(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    folder = _folder(spark)
    old, new = _write(spark, sf_dir, folder), _write(spark, sf_dir, folder, "tile_snapshot_copy")
    log = os.path.join(folder, "old-new.mfd")
    verbs.delta(spark, old, new, log)
    return old, new, log


def file_delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log between the two systems' files, applied to the first: its features are those of the second."""
    old, _, log = _delta(spark, sf_dir)
    out = old.replace(".map", "-applied.map")
    verbs.apply(spark, old, [log], out)
    return _summed(read_part(spark, out, "feature"))


def file_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles the change log has records for, with their water flag."""
    old, _, log = _delta(spark, sf_dir)
    register(spark)
    rows = spark.read.format("tilemap_patch").option("base", old).load(log)
    return rows.select("si", "x", "y", (F.col("flags").bitwiseAND(1) == 1).alias("is_water")).distinct()


def file_dump_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumped as text and loaded again."""
    path = _write(spark, sf_dir, _folder(spark))
    text, back = path + ".toml", path.replace(".map", "-loaded.map")
    with open(text, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in verbs.dump(spark, path, all=True))
    verbs.load(spark, text, back)
    return _summed(read_part(spark, back, "feature"))


QUERIES = {f.__name__: f for f in (file_header, file_tags, file_tile_index, file_tile_lookup, file_features, file_delta_apply, file_change_log, file_dump_load)}

# the grids of the file, whose box is that of all headers: tiles outside have no place in it
_GRID = """, bb as (select min(min_lat) s, min(min_lon) w, max(max_lat) n, max(max_lon) e from h), bx as (select si,
 trunc((w / 1e6 + 180.0) / 360.0 * pow(2.0, base))::bigint x0, trunc((1.0 - ln(tan(radians(n / 1e6)) + 1.0 / cos(radians(n / 1e6))) / pi()) / 2.0 * pow(2.0, base))::bigint y0,
 trunc((e / 1e6 + 180.0) / 360.0 * pow(2.0, base))::bigint x1, trunc((1.0 - ln(tan(radians(s / 1e6)) + 1.0 / cos(radians(s / 1e6))) / pi()) / 2.0 * pow(2.0, base))::bigint y1
 from bb, (values (0, 7), (1, 12), (2, 14)) z(si, base))"""
_IN = "join bx on t.si = bx.si and t.x between bx.x0 and bx.x1 and t.y between bx.y0 and bx.y1"
_LAST = ", {o}m as (select map_id, max(version) version from {t} group by map_id), {o}e as (select t.* from {e} t join {o}m m on t.map_id = m.map_id and t.version = m.version " + _IN + ")"
_LAST_A, _LAST_B = _LAST.format(o="a", t="t", e="e"), _LAST.format(o="b", t="tc", e="ec")
_SUMS = """select si, x, y, (zoom + case si when 0 then 0 when 1 then 8 else 13 end)::int zoom, kind, count(*)::bigint n, sum(coalesce(len(v.tags), 0))::bigint n_tags, sum(coalesce(v.layer, 0))::bigint layers,
 sum(coalesce(v.lat, 0) + coalesce(v.lon, 0))::bigint places, sum(coalesce(len(flatten(flatten(v.blocks))), 0))::bigint n_nodes, count(v.name)::bigint n_named from {0} group by all"""
_RANKED = "select kind, tag, row_number() over (partition by kind order by n desc, tag) - 1 tag_id from (select kind, tag, count(*) n from (select kind, unnest(v.tags) tag from ae) where tag is not null group by kind, tag)"
_TILES = "select t.si, t.x, t.y, coalesce(bool_and(is_water), false) is_water from {t} t join {o}m m on t.map_id = m.map_id and t.version = m.version " + _IN + " group by t.si, t.x, t.y"
ORACLES = {
    "file_header": _with("h t e") + _GRID + _LAST_A + f""", r as ({_RANKED}) select 5::bigint file_version, 1700000000000::decimal(20,0) creation_date, min(min_lat) min_lat, min(min_lon) min_lon, max(max_lat) max_lat, max(max_lon) max_lon,
 256 tile_size, 'Mercator' projection, false has_debug, 9 start_zoom, 'en' as language, 'all maps' as comment, (select count(*) from r where kind = 'poi')::int n_poi_tags, (select count(*) from r where kind = 'way')::int n_way_tags, 3 n_intervals from h""",
    "file_tags": _with("h t e") + _GRID + _LAST_A + f" select kind, tag_id::int tag_id, tag from ({_RANKED})",
    "file_tile_index": _with("h t e") + _GRID + _LAST_A + f", w as ({_TILES.format(t='t', o='a')}), f as (select distinct si, x, y from ae) select w.si, w.x, w.y, w.is_water, f.si is not null has_data from w left join f on w.si = f.si and w.x = f.x and w.y = f.y where f.si is not null or w.is_water",
    "file_tile_lookup": "select 2 si, 8256 x, 8256 y, true whole",
    "file_features": _with("h t e") + _GRID + _LAST_A + _SUMS.format("ae"),
    "file_delta_apply": _with("h tc ec") + _GRID + _LAST_B + _SUMS.format("be"),
    "file_change_log": _with("h t e tc ec") + _GRID + _LAST_A + _LAST_B + f""", wa as ({_TILES.format(t='t', o='a')}), wb as ({_TILES.format(t='tc', o='b')}),
 x as ((select si, x, y, zoom, kind, v from ae except all select si, x, y, zoom, kind, v from be) union all (select si, x, y, zoom, kind, v from be except all select si, x, y, zoom, kind, v from ae)),
 k as (select si, x, y from x union select coalesce(wa.si, wb.si), coalesce(wa.x, wb.x), coalesce(wa.y, wb.y) from wa full join wb on wa.si = wb.si and wa.x = wb.x and wa.y = wb.y where coalesce(wa.is_water, false) <> coalesce(wb.is_water, false))
 select k.si, k.x, k.y, coalesce(wb.is_water, false) is_water from k left join wb on k.si = wb.si and k.x = wb.x and k.y = wb.y""",
    "file_dump_load": _with("h t e") + _GRID + _LAST_A + _SUMS.format("ae"),
}
