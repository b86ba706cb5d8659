"""Queries over the map relations, one or more per operator, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import relations as R
from gridloom.functions import mercator as M
from gridloom.operators import changes as C
from gridloom.operators import dumping, merging, tiles, validation
from gridloom.operators import features as FE
from gridloom.operators import headers as HE
from gridloom.operators import tagging as TG
from gridloom.tables import current_rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The region the crop queries cut out, in micro-degrees: (min_lat, min_lon, max_lat, max_lon).
BOX = (-1_600_000, 900_000, -1_100_000, 1_500_000)
#: Bytes a feature counts for in the layout queries, whose tiles are not encoded.
FEATURE_BYTES = 16

# -- shared SQL ----------------------------------------------------------------------------------

_CTE = {
    "h": "select * from map_header qualify row_number() over (partition by map_id order by written_at desc nulls last) = 1",
    "hc": "select * replace (lower(trim(map_id)) as map_id) from map_header_copy qualify row_number() over (partition by map_id order by written_at desc nulls last) = 1",
    "zi": "select map_id, min_lat, min_lon, max_lat, max_lon, has_debug, z.si si, z.base_zoom base, z.min_zoom min, z.max_zoom max, z.pos pos, z.byte_size size from (select *, unnest(zoom_intervals) z from h)",
    "gr": """select *, x1 - x0 + 1 width, (x1 - x0 + 1) * (y1 - y0 + 1) n_tiles from (select map_id, si, base, has_debug,
  trunc((min_lon / 1e6 + 180.0) / 360.0 * pow(2.0, base))::bigint x0,
  trunc((1.0 - ln(tan(radians(max_lat / 1e6)) + 1.0 / cos(radians(max_lat / 1e6))) / pi()) / 2.0 * pow(2.0, base))::bigint y0,
  trunc((max_lon / 1e6 + 180.0) / 360.0 * pow(2.0, base))::bigint x1,
  trunc((1.0 - ln(tan(radians(min_lat / 1e6)) + 1.0 / cos(radians(min_lat / 1e6))) / pi()) / 2.0 * pow(2.0, base))::bigint y1 from zi)""",
    "d": "select map_id, kind, unnest(tags) tag, generate_subscripts(tags, 1) - 1 tag_id from (select map_id, 'poi' kind, poi_tags tags from h union all select map_id, 'way', way_tags from h)",
    "dc": "select map_id, kind, unnest(tags) tag, generate_subscripts(tags, 1) - 1 tag_id from (select map_id, 'poi' kind, poi_tags tags from hc union all select map_id, 'way', way_tags from hc)",
    "raw": """select 'poi' kind, map_id, si, tile_x x, tile_y y, zi, ord, layer, lat_diff lat, lon_diff lon, tags ids, feat_name as name, house_number, elevation,
  null::varchar reference, null::int label_lat, null::int label_lon, null::int sub_tile_bitmap, null::boolean encoding, null::int[][][][] blocks from poi
  qualify row_number() over (partition by map_id, si, tile_x, tile_y, zi, ord order by loaded_at desc nulls last) = 1
union all select 'way', map_id, si, tile_x, tile_y, zi, ord, layer, null, null, tags, feat_name, house_number, null, reference, label_lat, label_lon, sub_tile_bitmap, double_delta, blocks from way
  qualify row_number() over (partition by map_id, si, tile_x, tile_y, zi, ord order by loaded_at desc nulls last) = 1""",
    "f": """select r.*, r.zi + zi.min zoom, list_filter(list_transform(r.ids, lambda t: case when t >= 0 and t < len(h.ts) then h.ts[t + 1] end), lambda x: x is not null) tags
  from raw r left join (select map_id, 'poi' kind, poi_tags ts from h union all select map_id, 'way', way_tags from h) h on r.map_id = h.map_id and r.kind = h.kind
  left join zi on r.map_id = zi.map_id and r.si = zi.si""",
    "u": "select map_id, kind, zoom, unnest(tags) tag from f",
    "t": "select lower(trim(map_id)) map_id, snap_no as version, si, tile_x x, tile_y y, is_water, pois, ways from tile_snapshot qualify row_number() over (partition by lower(trim(map_id)), snap_no, si, tile_x, tile_y order by delivered_at desc nulls last) = 1",
    "tc": "select lower(trim(map_id)) map_id, snap_no as version, si, tile_x x, tile_y y, is_water, pois, ways from tile_snapshot_copy qualify row_number() over (partition by lower(trim(map_id)), snap_no, si, tile_x, tile_y order by delivered_at desc nulls last) = 1",
    "l": "select map_id || '#' || version as map_id, si, x, y, is_water, 16 * (coalesce(len(pois), 0) + coalesce(len(ways), 0)) length from t",
}
_ELEMENTS = """select map_id, version, si, x, y, 'poi' kind, e.zi_index zoom, struct_pack(layer := e.layer, lat := e.lat, lon := e.lon, tags := {tags}, name := e.feat_name, house := e.house_number,
  elevation := e.elevation, reference := null::varchar, la := null::int, lo := null::int, bm := null::int, enc := null::boolean, blocks := null::int[][][][]) v from (select *, unnest(pois) e from {src})
union all select map_id, version, si, x, y, 'way', e.zi_index, struct_pack(layer := e.layer, lat := null::int, lon := null::int, tags := {tags}, name := e.feat_name, house := e.house_number,
  elevation := null::int, reference := e.reference, la := e.label_lat, lo := e.label_lon, bm := e.sub_tile_bitmap, enc := e.double_delta, blocks := e.blocks) from (select *, unnest(ways) e from {src})"""
_CTE["e"] = _ELEMENTS.format(src="t", tags="list_sort(e.tags)")
_CTE["ec"] = _ELEMENTS.format(src="tc", tags="list_sort(e.tags)")
_CTE["es"] = _ELEMENTS.format(src="t", tags="e.tags")
_CTE["ecs"] = _ELEMENTS.format(src="tc", tags="e.tags")
_NEEDS = {"zi": "h", "gr": "h zi", "d": "h", "dc": "hc", "f": "h zi raw", "u": "h zi raw f", "l": "t", "e": "t", "ec": "tc", "es": "t", "ecs": "tc"}


def _with(names: str) -> str:
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, "").split(), n) if x not in order]
    return "with " + ",\n".join(f"{n} as ({_CTE[n]})" for n in order) + "\n"


def query(name: str, needs: str = "", sql: str | None = None):
    """Registers a query and, if given, its SQL over the named common tables."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (_with(needs) if needs else "") + sql
        return f

    return add


def _delivered(spark: SparkSession, d: str, name: str = "tile_snapshot") -> DataFrame:
    return R.snapshot_tiles(spark, d, name)


def _layout(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery as a map of its own: tiles with their length, and where the data starts."""
    t = _delivered(spark, d)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return t.select(
        F.concat_ws("#", "map_id", "version").alias("map_id"), "si", "x", "y", "is_water",
        (FEATURE_BYTES * (size("pois") + size("ways"))).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("data_start"),
    )


# -- projections and headers ---------------------------------------------------------------------


@query("tile_project", "h", """select map_id, z::int zoom, trunc((min_lon / 1e6 + 180.0) / 360.0 * pow(2.0, z))::bigint tx,
 trunc((1.0 - ln(tan(radians(min_lat / 1e6)) + 1.0 / cos(radians(min_lat / 1e6))) / pi()) / 2.0 * pow(2.0, z))::bigint ty from h, generate_series(0, 21) g(z)""")  # fmt: skip
def tile_project(spark, d):
    h = R.headers(spark, d).select("map_id", "min_lat", "min_lon", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("zoom"))
    return h.select("map_id", "zoom", M.tile_x(M.degrees("min_lon"), "zoom").alias("tx"), M.tile_y(M.degrees("min_lat"), "zoom").alias("ty"))


@query("tile_project_sql", "h", """select map_id, trunc((max_lon / 1e6 + 180.0) / 360.0 * pow(2.0, 14))::bigint tx,
 trunc((1.0 - ln(tan(radians(max_lat / 1e6)) + 1.0 / cos(radians(max_lat / 1e6))) / pi()) / 2.0 * pow(2.0, 14))::bigint ty from h""")  # fmt: skip
def tile_project_sql(spark, d):
    M.register_sql(spark)
    R.headers(spark, d).createOrReplaceTempView("gridloom_header")
    return spark.sql("select map_id, tile_x(max_lon / 1e6D, 14) tx, tile_y(max_lat / 1e6D, 14) ty from gridloom_header")


@query("tile_grids", "gr", "select map_id, si, x0, y0, x1, y1, width, n_tiles from gr")
def tile_grids(spark, d):
    return HE.grids(R.headers(spark, d)).select("map_id", "si", "x0", "y0", "x1", "y1", "width", "n_tiles")


@query("tile_linear_index", "gr t", """select t.map_id, t.version, t.si, t.x, t.y, (t.x - gr.x0) + gr.width * (t.y - gr.y0) i, gr.x0 + ((t.x - gr.x0) + gr.width * (t.y - gr.y0)) % gr.width back_x
 from t join gr on t.map_id = gr.map_id and t.si = gr.si where t.x between gr.x0 and gr.x1 and t.y between gr.y0 and gr.y1""")  # fmt: skip
def tile_linear_index(spark, d):
    t = _delivered(spark, d).select("map_id", "version", "si", "x", "y")
    j = t.join(HE.grids(R.headers(spark, d)).select("map_id", "si", "x0", "y0", "x1", "y1", "width"), ["map_id", "si"])
    i = M.linear_index("x", "y", "x0", "y0", "width")
    return j.where("x between x0 and x1 and y between y0 and y1").select("map_id", "version", "si", "x", "y", i.alias("i"), (F.col("x0") + i % F.col("width")).alias("back_x"))


@query("degrees_display", "h", "select map_id, min_lat / 1e6 min_lat, min_lon / 1e6 min_lon, max_lat / 1e6 max_lat, max_lon / 1e6 max_lon from h")
def degrees_display(spark, d):
    return R.headers(spark, d).select("map_id", *(M.degrees(c).alias(c) for c in HE.BBOX))


_CENTER = """select map_id, round(lat - km / 111.32, 6) min_lat, round(lon - km / (111.32 * cos(radians(lat))), 6) min_lon, round(lat + km / 111.32, 6) max_lat,
 round(lon + km / (111.32 * cos(radians(lat))), 6) max_lon from (select map_id, start_lat / 1e6 lat, start_lon / 1e6 lon, coalesce(start_zoom, 0) + 5.0 km from h where start_lat is not null)"""


@query("center_to_bbox", "h", _CENTER)
def center_to_bbox(spark, d):
    h = R.headers(spark, d).where("start_lat is not null").select("map_id", M.degrees("start_lat").alias("lat"), M.degrees("start_lon").alias("lon"), (F.coalesce("start_zoom", F.lit(0)) + 5.0).alias("km"))
    return h.select("map_id", *(c.alias(k) for k, c in M.center_bbox("lat", "lon", "km").items()))


@query("bbox_micro", "h", f"""select map_id, trunc(min_lat * 1000000.0)::int min_lat, trunc(min_lon * 1000000.0)::int min_lon, trunc(max_lat * 1000000.0)::int max_lat,
 trunc(max_lon * 1000000.0)::int max_lon from ({_CENTER})""")  # fmt: skip
def bbox_micro(spark, d):
    return center_to_bbox(spark, d).select("map_id", *(M.micro_degrees(c).alias(c) for c in HE.BBOX))


_CUT = "greatest(min_lat, {0}) min_lat, greatest(min_lon, {1}) min_lon, least(max_lat, {2}) max_lat, least(max_lon, {3}) max_lon".format(*BOX)


@query("bbox_intersect", "h", f"select * from (select map_id, {_CUT} from h) where min_lat <= max_lat and min_lon <= max_lon")
def bbox_intersect(spark, d):
    return HE.bbox_intersection(R.headers(spark, d), BOX)


@query("bbox_union", "h t", "select min(min_lat) min_lat, min(min_lon) min_lon, max(max_lat) max_lat, max(max_lon) max_lon from h where map_id in (select map_id from t)")
def bbox_union(spark, d):
    return HE.bbox_union(R.headers(spark, d), _delivered(spark, d))


@query("header_edit", "h", "select map_id, 'reviewed' as comment, 1700000000000::decimal(20,0) creation_date, created_by from h")
def header_edit(spark, d):
    return HE.edit_header(R.headers(spark, d), "reviewed", 1700000000000).select("map_id", "comment", "creation_date", "created_by")


@query("header_diff", "h hc", """, a as (unpivot (select map_id, min_lat::varchar min_lat, min_lon::varchar min_lon, max_lat::varchar max_lat, max_lon::varchar max_lon, tile_size::varchar tile_size, projection,
 start_zoom::varchar start_zoom, language_preference as language, created_by, header_comment as comment, creation_date::varchar creation_date from h) on columns(* exclude map_id) into name field value v),
b as (unpivot (select map_id, min_lat::varchar min_lat, min_lon::varchar min_lon, max_lat::varchar max_lat, max_lon::varchar max_lon, tile_size::varchar tile_size, projection,
 start_zoom::varchar start_zoom, language_preference as language, created_by, header_comment as comment, creation_date::varchar creation_date from hc) on columns(* exclude map_id) into name field value v)
select coalesce(a.map_id, b.map_id) map_id, coalesce(a.field, b.field) field, a.v old_value, b.v new_value from a full join b on a.map_id = b.map_id and a.field = b.field
where a.v is distinct from b.v and coalesce(a.map_id, b.map_id) in (select h.map_id from h join hc on h.map_id = hc.map_id)
union all select coalesce(h.map_id, hc.map_id), 'missing', case when h.map_id is null then 'yes' else 'no' end, case when hc.map_id is null then 'yes' else 'no' end
from h full join hc on h.map_id = hc.map_id where h.map_id is null or hc.map_id is null""")  # fmt: skip
def header_diff(spark, d):
    return HE.header_diff(R.headers(spark, d), R.headers(spark, d, "map_header_copy"))


@query("same_intervals", "h hc", """select h.map_id, list_transform(h.zoom_intervals, lambda z: struct_pack(a := z.base_zoom, b := z.min_zoom, c := z.max_zoom))
 is not distinct from list_transform(hc.zoom_intervals, lambda z: struct_pack(a := z.base_zoom, b := z.min_zoom, c := z.max_zoom)) same from h join hc on h.map_id = hc.map_id""")  # fmt: skip
def same_intervals(spark, d):
    return HE.same_intervals(R.headers(spark, d), R.headers(spark, d, "map_header_copy"))


@query("zoom_index_roundtrip", "zi", "select map_id, si, z::int zoom, (z - min)::int zi, (min + (z - min))::int back from zi, lateral (select unnest(generate_series(min, max)) z)")
def zoom_index_roundtrip(spark, d):
    z = HE.intervals(R.headers(spark, d)).select("map_id", "si", "min", F.explode(F.sequence("min", "max")).alias("zoom"))
    zi = F.col("zoom") - F.col("min")
    return z.select("map_id", "si", "zoom", zi.alias("zi"), (F.col("min") + zi).alias("back"))


# -- tile index ----------------------------------------------------------------------------------


@query("index_offsets", "l", """select map_id, si, x, y, length, coalesce(sum(length) over (partition by map_id, si order by y, x rows between unbounded preceding and 1 preceding), 0)::bigint "offset" from l""")
def index_offsets(spark, d):
    return tiles.offsets_from_lengths(_layout(spark, d)).select("map_id", "si", "x", "y", "length", "offset")


@query("tiles_nonempty", "l", "select map_id, si, x, y, length from l where length > 0")
def tiles_nonempty(spark, d):
    laid = tiles.offsets_from_lengths(_layout(spark, d))
    from pyspark.sql import Window

    size = F.sum("length").over(Window.partitionBy("map_id", "si"))
    again = tiles.lengths_from_offsets(laid.withColumn("size", size).drop("length"))
    return tiles.non_empty(again).select("map_id", "si", "x", "y", "length")


@query("subfile_has_data", "l", "select map_id, si, bool_or(length > 0) has_data from l group by map_id, si")
def subfile_has_data(spark, d):
    return tiles.subfiles_with_data(_layout(spark, d))


@query("subfile_by_base", "zi", "select map_id, min(si)::int si from zi where base = 14 group by map_id")
def subfile_by_base(spark, d):
    return HE.subfile_of_base(R.headers(spark, d), 14)


@query("subfile_containing", "zi", "select map_id, min(si)::int si from zi where min <= 12 and max >= 12 group by map_id")
def subfile_containing(spark, d):
    return HE.subfile_containing(R.headers(spark, d), 12)


@query("tiles_covered_by_inputs", "t gr", "select distinct t.si, t.x, t.y from t join gr on gr.si = t.si and t.x between gr.x0 and gr.x1 and t.y between gr.y0 and gr.y1")
def tiles_covered_by_inputs(spark, d):
    grid = HE.grids(R.headers(spark, d)).select("si", "x0", "y0", "x1", "y1").distinct()
    return tiles.covered_by(_delivered(spark, d).select("si", "x", "y").distinct(), grid)


@query("single_tile", "t", "select map_id, version, si, x, y, is_water from t where si = 2 and x = 8256 and y = 8256")
def single_tile(spark, d):
    return tiles.single_tile(_delivered(spark, d), 2, 8256, 8256).select("map_id", "version", "si", "x", "y", "is_water")


@query("grid_left_fill", "gr t", """, w as (select map_id, si, x, y, bool_and(is_water) is_water from t group by all), g as (select map_id, si, x, unnest(generate_series(y0, y1)) y
 from (select *, unnest(generate_series(x0, x1)) x from gr)) select g.map_id, g.si, g.x, g.y, coalesce(w.is_water, false) is_water, w.map_id is not null has_tile
 from g left join w on g.map_id = w.map_id and g.si = w.si and g.x = w.x and g.y = w.y""")  # fmt: skip
def grid_left_fill(spark, d):
    g = HE.grid_tiles(HE.grids(R.headers(spark, d)))
    w = _delivered(spark, d).groupBy("map_id", "si", "x", "y").agg(F.bool_and("is_water").alias("is_water"), F.lit(True).alias("has_tile"))
    no = F.lit(False)
    return g.join(w, ["map_id", "si", "x", "y"], "left").select("map_id", "si", "x", "y", F.coalesce("is_water", no).alias("is_water"), F.coalesce("has_tile", no).alias("has_tile"))


@query("coord_delta_code", "t", """, k as (select distinct map_id || '#' || version as map_id, si, x, y from t)
 select map_id, si, x, y, y - coalesce(py, 0) dy, case when py = y then x - px else x end dx
 from (select *, lag(y) over w py, lag(x) over w px from k window w as (partition by map_id, si order by y, x))""")  # fmt: skip
def coord_delta_code(spark, d):
    return FE.delta_coded(_layout(spark, d).select("map_id", "si", "x", "y"))


@query("coord_delta_decode", "t", "select distinct map_id || '#' || version as map_id, si, x::bigint x, y::bigint y from t")
def coord_delta_decode(spark, d):
    from pyspark.sql import Window

    coded = coord_delta_code(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("map_id", "si").orderBy("y", "x")))
    return FE.delta_decoded(coded.drop("x", "y")).select("map_id", "si", "x", "y")


# -- crop ----------------------------------------------------------------------------------------

_CROP_GRID = f"""select map_id, si, has_debug, x0, y0, x1, y1, (x1 - x0 + 1) * (y1 - y0 + 1) n_tiles from (select map_id, si, has_debug,
  trunc((min_lon / 1e6 + 180.0) / 360.0 * pow(2.0, base))::bigint x0,
  trunc((1.0 - ln(tan(radians(max_lat / 1e6)) + 1.0 / cos(radians(max_lat / 1e6))) / pi()) / 2.0 * pow(2.0, base))::bigint y0,
  trunc((max_lon / 1e6 + 180.0) / 360.0 * pow(2.0, base))::bigint x1,
  trunc((1.0 - ln(tan(radians(min_lat / 1e6)) + 1.0 / cos(radians(min_lat / 1e6))) / pi()) / 2.0 * pow(2.0, base))::bigint y1
  from (select map_id, si, base, has_debug, {_CUT} from zi) where min_lat <= max_lat and min_lon <= max_lon)"""


@query("crop_tiles", "zi t", f"""select t.map_id, t.version, t.si, t.x, t.y from t join ({_CROP_GRID}) g on t.map_id = g.map_id and t.si = g.si
 where t.x between g.x0 and g.x1 and t.y between g.y0 and g.y1""")  # fmt: skip
def crop_tiles(spark, d):
    return tiles.crop(R.headers(spark, d), _delivered(spark, d), BOX)[1].select("map_id", "version", "si", "x", "y")


@query("crop_features", "zi raw", f"""select r.map_id, r.kind, count(*)::bigint n from raw r join ({_CROP_GRID}) g on r.map_id = g.map_id and r.si = g.si
 where r.x between g.x0 and g.x1 and r.y between g.y0 and g.y1 group by r.map_id, r.kind""")  # fmt: skip
def crop_features(spark, d):
    return tiles.crop(R.headers(spark, d), R.features(spark, d), BOX)[1].groupBy("map_id", "kind").agg(F.count("*").alias("n"))


@query("crop_size_estimate", "zi t", f""", g as ({_CROP_GRID}), w as (select map_id, si, x, y, max(16 * (coalesce(len(pois), 0) + coalesce(len(ways), 0)))::bigint length from t group by all)
 select i.map_id, i.n_tiles::bigint n_tiles, coalesce(b.data_bytes, 0)::bigint data_bytes, i.index_bytes::bigint index_bytes from
 (select map_id, sum(n_tiles) n_tiles, sum(5 * n_tiles + case when has_debug then 16 else 0 end) index_bytes from g group by map_id) i left join
 (select w.map_id, sum(length) data_bytes from w join g on w.map_id = g.map_id and w.si = g.si where w.x between g.x0 and g.x1 and w.y between g.y0 and g.y1 group by w.map_id) b on i.map_id = b.map_id""")  # fmt: skip
def crop_size_estimate(spark, d):
    t = _delivered(spark, d)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    w = t.groupBy("map_id", "si", "x", "y").agg(F.max(FEATURE_BYTES * (size("pois") + size("ways"))).cast("bigint").alias("length"))
    return tiles.size_estimate(w, HE.grids(tiles.cropped_header(R.headers(spark, d), BOX)))


# -- tags and dictionaries -----------------------------------------------------------------------


@query("tag_stats_by_zoom", "u", "select map_id, kind, tag, zoom, count(*)::bigint n from u where tag is not null group by all")
def tag_stats_by_zoom(spark, d):
    return TG.tag_counts(R.features(spark, d))


@query("tag_stats", "u d", """select d.map_id, d.kind, d.tag, coalesce(c.n, 0)::bigint "count", coalesce(c.appear, 9999)::int appear from (select distinct map_id, kind, tag from d where tag is not null) d
 left join (select map_id, kind, tag, count(*) n, min(zoom) appear from u group by all) c on d.map_id = c.map_id and d.kind = c.kind and d.tag = c.tag""")  # fmt: skip
def tag_stats(spark, d):
    return TG.tag_stats(TG.tag_counts(R.features(spark, d)), TG.dictionary(R.headers(spark, d)))


_ZOOMS = range(0, 22)


@query("tag_zoom_pivot", "u", "select kind, tag, " + ", ".join(f"coalesce(sum(case when zoom = {z} then 1 end), 0)::bigint z{z}" for z in _ZOOMS) + " from u group by kind, tag")
def tag_zoom_pivot(spark, d):
    return TG.zoom_pivot(TG.tag_counts(R.features(spark, d), ()), list(_ZOOMS))


@query("tag_report_rounded", "u", "select kind, tag, zoom, (n - n % (10 ** (length(n::varchar) - 1))::bigint)::bigint n from (select kind, tag, zoom, count(*)::bigint n from u group by all)")
def tag_report_rounded(spark, d):
    return TG.tag_counts(R.features(spark, d), ()).select("kind", "tag", "zoom", TG.rounded(F.col("n")).alias("n"))


@query("merge_dictionary", "u", "select kind, tag, n, (row_number() over (partition by kind order by n desc, tag) - 1)::bigint tag_id from (select kind, tag, count(*)::bigint n from u group by kind, tag)")
def merge_dictionary(spark, d):
    return TG.ranked_dictionary(R.features(spark, d))


@query("map_dictionary", "u", "select map_id, kind, tag, n, (row_number() over (partition by map_id, kind order by n desc, tag) - 1)::bigint tag_id from (select map_id, kind, tag, count(*)::bigint n from u group by all)")
def map_dictionary(spark, d):
    return TG.ranked_dictionary(R.features(spark, d), ["map_id"])


_TAG_MAP = "select d.map_id, d.kind, d.tag_id::bigint old_id, d.tag, n.new_id::bigint new_id from d left join (select map_id, kind, tag, max(tag_id) new_id from dc group by all) n on d.map_id = n.map_id and d.kind = n.kind and d.tag = n.tag"


_VERSIONS = {"base": "map_header", "copy": "map_header_copy"}


def _tag_versions(spark, d):
    return TG.dictionary_versions({v: R.headers(spark, d, t) for v, t in _VERSIONS.items()})


@query("tag_map_old_new", "d dc", _TAG_MAP)
def tag_map_old_new(spark, d):
    return TG.tag_map(_tag_versions(spark, d), *_VERSIONS)


@query("mapping_identity", "d dc", f"select map_id, kind, bool_and(new_id is not distinct from old_id) is_identity, bool_or(new_id is null) loses_tags from ({_TAG_MAP}) group by map_id, kind")
def mapping_identity(spark, d):
    return TG.tag_map_facts(tag_map_old_new(spark, d))


@query("cross_version_tag_map", "d dc", """, v as (select 'base' ver, * from d union all select 'copy', * from dc), n as (select ver, map_id, kind, tag, max(tag_id) new_id from v group by all)
 select v.ver from_ver, w.ver to_ver, v.map_id, v.kind, v.tag_id::bigint old_id, v.tag, n.new_id::bigint new_id from v join (values ('base'), ('copy')) w(ver) on true
 left join n on n.ver = w.ver and v.map_id = n.map_id and v.kind = n.kind and v.tag = n.tag""")  # fmt: skip
def cross_version_tag_map(spark, d):
    return TG.cross_version_map(_tag_versions(spark, d), _VERSIONS).select("from_ver", "to_ver", "map_id", "kind", "old_id", "tag", "new_id")


@query("tag_diff_encode", "d dc", """select dc.map_id, dc.kind, dc.tag_id::bigint tag_id, coalesce(o.old_id + 1, 0)::bigint ref, case when o.old_id is null then dc.tag end literal
 from dc left join (select map_id, kind, tag, max(tag_id) old_id from d group by all) o on dc.map_id = o.map_id and dc.kind = o.kind and dc.tag = o.tag""")  # fmt: skip
def tag_diff_encode(spark, d):
    return TG.tag_diff(_tag_versions(spark, d), *_VERSIONS)


@query("tag_diff_decode", "dc", "select map_id, kind, tag_id::bigint tag_id, tag from dc")
def tag_diff_decode(spark, d):
    return TG.tag_diff_decoded(tag_diff_encode(spark, d), R.headers(spark, d))


def _split(spark, d):
    return TG.split_by_dictionary(R.features(spark, d, merge=True), _tag_versions(spark, d), *_VERSIONS)


_ALLOWED = ", al as (select map_id, kind, list(distinct tag) tags from dc where tag is not null group by map_id, kind), s as (select f.*, len(list_filter(coalesce(f.tags, []), lambda t: not list_contains(coalesce(al.tags, []), t))) = 0 mapped from f left join al on f.map_id = al.map_id and f.kind = al.kind)\n"


@query("drop_unmapped_features", "f dc", _ALLOWED + "select map_id, kind, count(*)::bigint n, count(*) filter (mapped)::bigint kept from s group by map_id, kind")
def drop_unmapped_features(spark, d):
    return _split(spark, d).groupBy("map_id", "kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("mapped"), 1)).alias("kept"))


@query("tile_zoom_erased", "f dc", _ALLOWED + "select map_id, si, x, y, zoom, kind, count(*)::bigint n from s group by map_id, si, x, y, zoom, kind having count(*) filter (mapped) = 0")
def tile_zoom_erased(spark, d):
    return TG.erased_rows(_split(spark, d), ["map_id", "si", "x", "y", "zoom", "kind"])


@query("load_tags_parse", "f", "select map_id, kind, si, x, y, zi, ord, array_to_string(tags, chr(31)) tags from f where len(tags) > 0")
def load_tags_parse(spark, d):
    f = R.features(spark, d).where("size(tags) > 0")
    lowest = HE.intervals(R.headers(spark, d)).select("map_id", "si", "min")
    line = f.join(lowest, ["map_id", "si"], "left").withColumn("zi", F.col("zoom") - F.col("min")).withColumn("line", F.concat(F.lit("tags = "), dumping.tag_list(F.col("tags"))))
    return line.select("map_id", "kind", "si", "x", "y", "zi", "ord", F.array_join(dumping.parse_tag_list(F.col("line")), "\x1f").alias("tags"))


# -- features ------------------------------------------------------------------------------------

_TEXT = """concat_ws('|', kind, coalesce(layer::varchar, '~'), coalesce(lat::varchar, '~'), coalesce(lon::varchar, '~'), coalesce(array_to_string(list_sort(tags), ','), '~'), coalesce(name, '~'), coalesce(house_number, '~'),
 coalesce(elevation::varchar, '~'), coalesce(reference, '~'), coalesce(label_lat::varchar, '~'), coalesce(label_lon::varchar, '~'), coalesce(sub_tile_bitmap::varchar, '~'), coalesce(encoding::varchar, '~'), coalesce(to_json(blocks)::varchar, '~'))"""
_HASHED = f"select map_id, si, x, y, zoom, kind, cast('0x' || substr(md5({_TEXT}), 1, 15) as bigint) h from f"
_DIGESTS = f"select map_id, si, x, y, zoom, kind, count(*)::bigint n, ((sum(h::hugeint) + count(*)) % 2305843009213693951)::bigint digest from ({_HASHED}) group by all"


def _hashed(spark, d):
    f = R.features(spark, d)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    parts = [F.col("kind"), *(text(F.col(c)) for c in ("layer", "lat", "lon")), text(F.array_join(F.array_sort("tags"), ",")), *(text(F.col(c)) for c in ("name", "house_number", "elevation", "reference", "label_lat", "label_lon", "sub_tile_bitmap", "encoding")), text(F.to_json("blocks"))]
    return f.select("map_id", "si", "x", "y", "zoom", "kind", FE.portable_hash(F.concat_ws("|", *parts)).alias("h"))


@query("tile_digest", "f", _DIGESTS)
def tile_digest(spark, d):
    return FE.tile_digests(_hashed(spark, d), ["map_id", "si", "x", "y", "zoom", "kind"])


@query("map_digest", "f", f"""select map_id, sha256(string_agg(d, chr(10) order by si, x)) digest from (select map_id, si, x, sha256(string_agg(concat_ws('/', y, zoom, kind, n, digest), chr(10) order by y, zoom, kind)) d
 from ({_DIGESTS}) group by map_id, si, x) group by map_id""")  # fmt: skip
def map_digest(spark, d):
    return FE.map_digest(tile_digest(spark, d))


@query("tile_feature_counts", "f", "select map_id, si, x, y, zoom, count(*) filter (kind = 'poi')::bigint n_pois, count(*) filter (kind = 'way')::bigint n_ways from f group by all")
def tile_feature_counts(spark, d):
    return FE.zoom_row_counts(R.features(spark, d))


@query("canonical_feature_order", "f", """select map_id, si, x, y, zoom, kind, ord, row_number() over (partition by map_id, si, x, y, zoom, kind order by layer nulls first, lon nulls first, lat nulls first,
 array_to_string(list_sort(tags), chr(1)) nulls first, name nulls first, house_number nulls first, elevation nulls first, reference nulls first, sub_tile_bitmap nulls first, ord)::bigint rank from f""")  # fmt: skip
def canonical_feature_order(spark, d):
    return FE.canonical_rank(R.features(spark, d)).select("map_id", "si", "x", "y", "zoom", "kind", "ord", "rank")


_COMPAT = """case when kind = 'poi' then concat_ws('|', 'p', coalesce(layer::varchar, '~'), coalesce(lon::varchar, '~'), coalesce(lat::varchar, '~'), coalesce(array_to_string(list_sort(tags), ','), '~'), coalesce(name, '~'),
 coalesce(case when name is null then house_number end, '~'), coalesce(case when name is null and house_number is null then elevation end::varchar, '~'))
 else concat_ws('|', 'w', coalesce(layer::varchar, '~'), coalesce(label_lat::varchar, '~'), coalesce(label_lon::varchar, '~'), coalesce(array_to_string(list_sort(tags), ','), '~'), coalesce(name, ''), coalesce(house_number, ''), coalesce(reference, ''),
 coalesce(to_json(blocks)::varchar, '~'), coalesce(sub_tile_bitmap::varchar, '~')) end"""


@query("compat_equality_groups", "f", f"""select map_id, si, x, y, zoom, kind, count(*)::bigint n_groups, sum(n)::bigint n_features, max(n)::bigint largest
 from (select map_id, si, x, y, zoom, kind, {_COMPAT} k, count(*) n from f group by all) group by all""")  # fmt: skip
def compat_equality_groups(spark, d):
    c = FE.element_counts(R.features(spark, d), "compat")
    return c.groupBy("map_id", "si", "x", "y", "zoom", "kind").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_features"), F.max("n").alias("largest"))


@query("way_node_counts", "raw", """select map_id, si, x, y, zi, ord, len(blocks)::int n_blocks, list_sum(list_transform(blocks, lambda b: len(b)))::int n_segments,
 list_sum(list_transform(blocks, lambda b: list_sum(list_transform(b, lambda s: len(s)))))::int n_nodes from raw where kind = 'way' and len(blocks) > 0""")  # fmt: skip
def way_node_counts(spark, d):
    f = _ways(spark, d).where("size(blocks) > 0")
    total = lambda c, g: F.aggregate(c, F.lit(0), lambda a, x: a + g(x))
    nodes = total(F.col("blocks"), lambda b: total(b, F.size))
    return f.select("map_id", "si", "x", "y", "zi", "ord", F.size("blocks").alias("n_blocks"), total(F.col("blocks"), F.size).alias("n_segments"), nodes.alias("n_nodes"))


def _ways(spark, d):
    w = table(spark, d, "way").select("map_id", "si", F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), "zi", "ord", "double_delta", "blocks", "loaded_at")
    return current_rows(w, ["map_id", "si", "x", "y", "zi", "ord"], "loaded_at")


def _nodes(spark, d):
    w = _ways(spark, d).select("map_id", "si", "x", "y", "zi", "ord", "double_delta", F.posexplode("blocks").alias("b", "segments"))
    s = w.select("map_id", "si", "x", "y", "zi", "ord", "double_delta", "b", F.posexplode("segments").alias("s", "nodes"))
    n = s.select("map_id", "si", "x", "y", "zi", "ord", "double_delta", "b", "s", F.posexplode("nodes").alias("i", "node"))
    return n.select("map_id", "si", "x", "y", "zi", "ord", "double_delta", "b", "s", "i", F.col("node")[0].alias("dlat"), F.col("node")[1].alias("dlon"))


@query("way_assemble", "raw", """select map_id, si, x, y, zi, ord, array_to_string(list_transform(flatten(flatten(blocks)), lambda n: n[1] || ' ' || n[2]), ';') nodes
 from raw where kind = 'way' and len(flatten(flatten(blocks))) > 0""")  # fmt: skip
def way_assemble(spark, d):
    group = ["map_id", "si", "x", "y", "zi", "ord"]
    text = F.struct("b", "s", "i", F.concat_ws(" ", "dlat", "dlon").alias("node"))
    nodes = _nodes(spark, d).groupBy(*group).agg(F.array_sort(F.collect_list(text)).alias("nodes"))
    return nodes.select(*group, F.array_join(F.transform("nodes", lambda n: n["node"]), ";").alias("nodes"))


@query("way_absolute_nodes", "raw", """, b as (select map_id, si, x, y, zi, ord, coalesce(encoding, false) twice, unnest(blocks) segs, generate_subscripts(blocks, 1) - 1 b from raw where kind = 'way'),
 s as (select * exclude segs, unnest(segs) ns, generate_subscripts(segs, 1) - 1 s from b), n as (select * exclude ns, unnest(ns) nd, generate_subscripts(ns, 1) - 1 i from s),
 d as (select *, case when twice and i > 0 then sum(case when twice and i > 0 then nd[1] end) over w else nd[1] end dlat, case when twice and i > 0 then sum(case when twice and i > 0 then nd[2] end) over w else nd[2] end dlon
  from n window w as (partition by map_id, si, x, y, zi, ord, b, s order by i))
 select map_id, si, x, y, zi, ord, b::int b, s::int s, i::int i, cast(sum(dlat) over w as bigint) lat, cast(sum(dlon) over w as bigint) lon from d window w as (partition by map_id, si, x, y, zi, ord, b, s order by i)""")  # fmt: skip
def way_absolute_nodes(spark, d):
    return FE.absolute_nodes(_nodes(spark, d)).drop("double_delta", "dlat", "dlon")


@query("dump_lines", "f", """select map_id, kind, si, x, y, zi, ord, concat_ws(chr(10), case when kind = 'poi' then '[[tiles.pois]]' else '[[tiles.ways]]' end, 'zi_index = ' || zi, 'lat = ' || lat, 'lon = ' || lon, 'layer = ' || layer,
 'sub_tile_bitmap = ' || sub_tile_bitmap, case when kind = 'way' then 'encoding = ' || case when encoding then 'true' else 'false' end end,
 'tags = [' || array_to_string(list_transform(coalesce(tags, []), lambda t: '"' || replace(replace(t, '\\', '\\\\'), '"', '\\"') || '"'), ', ') || ']',
 'name = "' || replace(replace(name, '\\', '\\\\'), '"', '\\"') || '"', 'house_number = "' || replace(replace(house_number, '\\', '\\\\'), '"', '\\"') || '"', 'reference = "' || replace(replace(reference, '\\', '\\\\'), '"', '\\"') || '"',
 'elevation = ' || elevation, 'label_lat = ' || label_lat, 'label_lon = ' || label_lon, 'blocks = ' || to_json(blocks)::varchar) as text from f""")  # fmt: skip
def dump_lines(spark, d):
    lowest = HE.intervals(R.headers(spark, d)).select("map_id", "si", "min")
    f = R.features(spark, d).join(lowest, ["map_id", "si"], "left").withColumn("zi", F.col("zoom") - F.col("min"))
    return dumping.feature_lines(f).select("map_id", "kind", "si", "x", "y", "zi", "ord", F.array_join("lines", "\n").alias("text"))


# -- two versions --------------------------------------------------------------------------------

_TILE = ["map_id", "version", "si", "x", "y"]
_TILE_ON = " and ".join(f"a.{c} = b.{c}" for c in _TILE)


def _versions(spark, d):
    return tuple(_delivered(spark, d, t) for t in ("tile_snapshot", "tile_snapshot_copy"))


@query("tile_full_outer", "t tc", "select " + ", ".join(f"coalesce(a.{c}, b.{c}) {c}" for c in _TILE) + f", a.map_id is not null in_old, b.map_id is not null in_new, a.is_water old_water, b.is_water new_water from t a full join tc b on {_TILE_ON}")
def tile_full_outer(spark, d):
    return C.tile_presence(*_versions(spark, d), _TILE)


@query("tile_right_outer_changes", "t tc", f"select {', '.join('b.' + c for c in _TILE)}, a.map_id is null is_new from t a right join tc b on {_TILE_ON} where a.map_id is null or a.is_water is distinct from b.is_water")
def tile_right_outer_changes(spark, d):
    j = C.tile_presence(*_versions(spark, d), _TILE, "right_outer")
    return j.where(~F.col("in_old") | ~F.col("old_water").eqNullSafe(F.col("new_water"))).select(*_TILE, (~F.col("in_old")).alias("is_new"))


_ROW = "map_id, version, si, x, y, zoom, kind"


def _bag_sql(a: str, b: str) -> str:
    return f"""select {_ROW}, '-' change, count(*)::bigint n from (select {_ROW}, v from {a} except all select {_ROW}, v from {b}) group by all
union all select {_ROW}, '+', count(*)::bigint from (select {_ROW}, v from {b} except all select {_ROW}, v from {a}) group by all"""


def _bags(spark, d, **options):
    a, b = (R.snapshot_features(t) for t in _versions(spark, d))
    c = FE.bag_difference(a, b, extra=["version"], **options)
    return c.groupBy("map_id", "version", "si", "x", "y", "zoom", "kind", "change").agg(F.sum("n").alias("n"))


@query("element_bag_diff", "e ec", _bag_sql("e", "ec"))
def element_bag_diff(spark, d):
    return _bags(spark, d)


@query("element_bag_diff_strict", "es ecs", _bag_sql("es", "ecs"))
def element_bag_diff_strict(spark, d):
    """The order of tags counts too."""
    return _bags(spark, d, strict_tags=True)


_CV = """case when kind = 'poi' then concat_ws('|', coalesce(v.layer::varchar, '~'), v.lon, v.lat, v.tags::varchar, coalesce(v.name, '~'), coalesce(case when v.name is null then v.house end, '~'), coalesce(case when v.name is null and v.house is null then v.elevation end::varchar, '~'))
 else concat_ws('|', coalesce(v.layer::varchar, '~'), coalesce(v.la::varchar, '~'), coalesce(v.lo::varchar, '~'), v.tags::varchar, coalesce(v.name, ''), coalesce(v.house, ''), coalesce(v.reference, ''), v.blocks::varchar, v.bm) end v"""


@query("element_bag_diff_compat", "e ec", f", k as (select {_ROW}, {_CV} from e), kc as (select {_ROW}, {_CV} from ec)\n" + _bag_sql("k", "kc"))
def element_bag_diff_compat(spark, d):
    """Equality as older tools see it: a name or house number ends the comparison of points."""
    return _bags(spark, d, mode="compat")


@query("tile_diff", "t tc e ec", f""", g as ({_bag_sql('e', 'ec')}), s as (select map_id, version, si, x, y, sum(case when change = '-' then n end) m, sum(case when change = '+' then n end) p from g group by all),
 j as (select {', '.join(f'coalesce(a.{c}, b.{c}) {c}' for c in _TILE)}, a.map_id is not null in_old, b.map_id is not null in_new, a.map_id is not null and b.map_id is not null and a.is_water is distinct from b.is_water water_differs from t a full join tc b on {_TILE_ON})
 select {', '.join('j.' + c for c in _TILE)}, in_old, in_new, water_differs, coalesce(m, 0)::bigint n_removed, coalesce(p, 0)::bigint n_added from j
 left join s on {' and '.join(f'j.{c} = s.{c}' for c in _TILE)} where in_old <> in_new or water_differs or s.map_id is not null""")  # fmt: skip
def tile_diff(spark, d):
    a, b = _versions(spark, d)
    return C.tile_diff(a, b, R.snapshot_features(a), R.snapshot_features(b), _TILE)


@query("delta_rows", "e ec", f"select {_ROW}, -count(*)::bigint net from (select {_ROW}, v from e except all select {_ROW}, v from ec) group by all union all select {_ROW}, count(*)::bigint from (select {_ROW}, v from ec except all select {_ROW}, v from e) group by all".replace("-count(*)::bigint", "(-count(*))::bigint"))
def delta_rows(spark, d):
    a, b = (R.snapshot_features(t) for t in _versions(spark, d))
    log = C.change_log(a, b, ["version"])
    sign = F.signum("net")
    return log.groupBy("map_id", "version", "si", "x", "y", "zoom", "kind", sign.alias("s")).agg(F.sum("net").alias("net")).drop("s")


@query("latest_version_per_tile_zoom", "e", "select map_id, si, x, y, zoom, max(version)::int as version from e group by map_id, si, x, y, zoom")
def latest_version_per_tile_zoom(spark, d):
    return C.latest(R.snapshot_features(_delivered(spark, d)), ["map_id", "si", "x", "y", "zoom"], "version")


@query("stale_tiles", "t", """select map_id, version, si, x, y from t a where exists (select 1 from (select distinct map_id, version from t) v where v.map_id = a.map_id and v.version > a.version
 and not exists (select 1 from t b where b.map_id = v.map_id and b.version = v.version and b.si = a.si and b.x = a.x and b.y = a.y))""")  # fmt: skip
def stale_tiles(spark, d):
    t = _delivered(spark, d).select("map_id", "version", "si", "x", "y")
    return C.stale(t, t, ["map_id"], ["si", "x", "y"], "version").select("map_id", "version", "si", "x", "y")


# -- merge ---------------------------------------------------------------------------------------


@query("merge_union_all", "f", "select si, x, y, zoom, kind, count(*)::bigint n from f group by all")
def merge_union_all(spark, d):
    """All maps merged into one: no feature is dropped as a duplicate."""
    f = R.features(spark, d)
    return merging.union_features(f.where("kind = 'poi'"), f.where("kind = 'way'")).groupBy("si", "x", "y", "zoom", "kind").agg(F.count("*").alias("n"))


@query("merge_water_flag", "t", "select si, x, y, coalesce(bool_and(is_water), false) is_water, count(distinct map_id)::bigint n_maps from t group by si, x, y")
def merge_water_flag(spark, d):
    return merging.merged_water(_delivered(spark, d))


# -- validation ----------------------------------------------------------------------------------


@query("validate_headers", "h zi", """, g as (select map_id, case when start_zoom is null then max_lat else min_lat end min_lat, min_lon, case when start_zoom is null then min_lat else max_lat end max_lat, max_lon from h),
 y as (select map_id, si, case when si = 1 then max + 1 else base end base, min, max from zi)
select map_id, 'R03' rule, null::int si, null::int x, null::int y, concat_ws(',', min_lat, min_lon, max_lat, max_lon) detail from g where min_lat > max_lat or min_lon > max_lon
union all select map_id, 'R04', si, null, null, concat_ws(',', base, min, max) from y where min > base or base > max""")  # fmt: skip
def validate_headers(spark, d):
    """Headers broken on purpose, as the tables hold none: boxes upside down where no start zoom is set, a base zoom past its levels."""
    h = R.headers(spark, d)
    down = F.col("start_zoom").isNull()
    broken = F.transform("zoom_intervals", lambda z: F.when(z["si"] == 1, z.withField("base", z["max"] + 1)).otherwise(z))
    h = h.select("map_id", "min_lon", "max_lon", F.when(down, F.col("max_lat")).otherwise(F.col("min_lat")).alias("min_lat"), F.when(down, F.col("min_lat")).otherwise(F.col("max_lat")).alias("max_lat"), broken.alias("zoom_intervals"))
    return validation.header_violations(h)


@query("validate_offsets", "t", """, o as (select map_id || '#' || version as map_id, si, x, y, first_way_offset "offset" from
 (select lower(trim(map_id)) map_id, snap_no as version, si, tile_x x, tile_y y, first_way_offset from tile_snapshot qualify row_number() over (partition by lower(trim(map_id)), snap_no, si, tile_x, tile_y order by delivered_at desc nulls last) = 1)),
 q as (select *, lag("offset") over (partition by map_id, si order by y, x) b from o)
 select map_id, 'R10' rule, si, x, y, "offset"::varchar detail from q where "offset" < 4 union all select map_id, 'R11', si, x, y, "offset"::varchar from q where "offset" > 400
 union all select map_id, 'R12', si, x, y, concat_ws('>', b, "offset") from q where b > "offset" """)  # fmt: skip
def validate_offsets(spark, d):
    """The offset rules on a column that is no running offset, so that they find something."""
    t = _delivered(spark, d).select(F.concat_ws("#", "map_id", "version").alias("map_id"), "si", "x", "y", F.col("first_way_offset").alias("offset"))
    return validation.offset_violations(t.withColumn("data_start", F.lit(4)).withColumn("size", F.lit(400)))


@query("validate_features", "raw h", """, n as (select map_id, 'poi' kind, len(poi_tags) n from h union all select map_id, 'way', len(way_tags) from h), j as (select raw.*, coalesce(n.n, 0) n from raw left join n on raw.map_id = n.map_id and raw.kind = n.kind)
 select map_id, case kind when 'poi' then 'R17' else 'R18' end rule, si, x, y, (2 * layer)::varchar detail from j where 2 * layer not between -5 and 5
 union all select map_id, case kind when 'poi' then 'R19' else 'R20' end, si, x, y, t::varchar from (select *, unnest(ids) t from j) where t is not null and (t < 0 or t >= n)""")  # fmt: skip
def validate_features(spark, d):
    """The feature rules; layers are doubled, as the tables hold none out of range."""
    parts = [table(spark, d, k).select(F.lit(k).alias("kind"), "map_id", "si", "tile_x", "tile_y", "zi", "ord", "layer", "tags", "loaded_at") for k in ("poi", "way")]
    now = current_rows(parts[0].unionByName(parts[1]), ["kind", "map_id", "si", "tile_x", "tile_y", "zi", "ord"], "loaded_at")
    sizes = R.headers(spark, d).select("map_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.size(f"{k}_tags").alias("n_tags")) for k in ("poi", "way")))))
    raw = now.join(sizes, ["map_id", "kind"], "left").select("map_id", "kind", "si", F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), (2 * F.col("layer")).alias("layer"), F.col("tags").alias("tag_ids"), "n_tags")
    return validation.feature_violations(raw)


# -- the shipped change log beside the derived one -------------------------------------------------


@query("change_log_check", "t", """, s as (select map_id, version, lead(version) over (partition by map_id order by version) nxt from (select distinct map_id, version from t)),
 w as (select a.map_id, s.version from_snap, s.nxt to_snap, a.si, a.x, a.y from t a join s on a.map_id = s.map_id and a.version = s.version join t b on b.map_id = a.map_id and b.version = s.nxt and b.si = a.si and b.x = a.x and b.y = a.y where a.is_water is distinct from b.is_water),
 m as (select map_id, from_snap, to_snap, si, tile_x x, tile_y y, (flags & 1) = 1 says_water from mfd_tile_record qualify row_number() over (partition by map_id, from_snap, to_snap, si, tile_x, tile_y order by logged_at desc nulls last) = 1)
 select w.map_id, w.from_snap, w.to_snap, w.si, w.x, w.y, m.map_id is not null logged from w left join m on w.map_id = m.map_id and w.from_snap = m.from_snap and w.to_snap = m.to_snap and w.si = m.si and w.x = m.x and w.y = m.y""")  # fmt: skip
def change_log_check(spark, d):
    """Every water flag that changed between deliveries, and whether the shipped log has a record for the tile."""
    from gridloom.operators.snapshots import label_changes, snapshot_residues

    t = _delivered(spark, d).select("map_id", "version", "si", "x", "y", F.coalesce(F.col("is_water").cast("string"), F.lit("null")).alias("water"))
    key = ["map_id", "from_snap", "to_snap", "si", "x", "y"]
    changed = label_changes(snapshot_residues(t, ["map_id"], "version", ["si", "x", "y", "water"]), key, "water").where("change = 'changed'")
    log = table(spark, d, "mfd_tile_record").select("map_id", "from_snap", "to_snap", "si", F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), "logged_at")
    logged = log.groupBy(*key).agg(F.lit(True).alias("logged"))
    return changed.select(*key).join(logged, key, "left").select(*key, F.coalesce("logged", F.lit(False)).alias("logged"))
