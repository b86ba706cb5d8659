"""Queries p2, p3 and p5: copies, snapshots and hot keys, over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.copies import comparable, copy_differences, digest
from gridloom.operators.hotkeys import dense_key_sums
from gridloom.operators.snapshots import label_changes, snapshot_residues
from gridloom.tables import FEATURE_KEY, TILE_KEY, current_rows, folded, table

POI_FIELDS = ("zi_index", "lat", "lon", "layer", "feat_name", "house_number", "elevation")
WAY_FIELDS = ("zi_index", "layer", "sub_tile_bitmap", "double_delta", "feat_name", "house_number", "reference", "label_lat", "label_lon", "blocks")


def _element(e: Column, fields: tuple[str, ...]) -> Column:
    """A feature with its tags sorted. Named JSON fields keep nulls apart from one another."""
    return F.struct(*(e[f].alias(f) for f in fields), F.array_sort(e["tags"]).alias("tags"))


def _multiset(column: str, fields: tuple[str, ...]) -> Column:
    return F.array_sort(F.transform(F.col(column), lambda e: _element(e, fields)))


# -- p2: two copies ------------------------------------------------------------------------------

_COPY_KEY = ("rel", "map_id", "snap_no", "si", "tile_x", "tile_y")
_COPY_FIELDS = ("creation_date", "header_comment", "is_water", "ways")


def _header_side(df: DataFrame) -> DataFrame:
    none = F.lit(-1)
    keys = {"rel": F.lit("map_header"), "map_id": folded("map_id"), "snap_no": none, "si": none, "tile_x": none, "tile_y": none}
    empty = F.lit(None)
    fields = {"creation_date": F.col("creation_date"), "header_comment": digest(F.col("header_comment")), "is_water": empty, "ways": empty}
    return comparable(df, keys, fields, "written_at")


def _tile_side(df: DataFrame) -> DataFrame:
    keys = {"rel": F.lit("tile_snapshot"), "map_id": folded("map_id")} | {k: F.col(k) for k in TILE_KEY[1:]}
    empty = F.lit(None)
    fields = {"creation_date": empty, "header_comment": empty, "is_water": F.col("is_water"), "ways": digest(F.to_json(_multiset("ways", WAY_FIELDS)))}
    return comparable(df, keys, fields, "delivered_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for suffix in ("", "_copy"):
        header, tile = table(spark, sf_dir, f"map_header{suffix}"), table(spark, sf_dir, f"tile_snapshot{suffix}")
        sides.append(_header_side(header).unionByName(_tile_side(tile)))
    return copy_differences(*sides, _COPY_KEY, _COPY_FIELDS)


# -- p3: consecutive snapshots -------------------------------------------------------------------


def _tile_parts(df: DataFrame) -> DataFrame:
    """Per current tile one row for the tile itself (zi -1, its water flag) and one per zoom row.

    A zoom row is 128 bits of the SHA-256 of its canonical text: only rows of one key are compared.
    """
    zooms = F.array_distinct(F.concat(F.transform("__p", lambda e: e["zi_index"]), F.transform("__w", lambda e: e["zi_index"])))

    def part(z: Column) -> Column:
        mine = [F.to_json(F.filter(F.col(c), lambda e: e["zi_index"].eqNullSafe(z))) for c in ("__p", "__w")]
        return F.struct(z.alias("zi"), F.substring(F.unhex(F.sha2(F.concat_ws("|", *mine).cast("binary"), 256)), 1, 16).alias("value"))

    slim = df.select(
        *TILE_KEY,
        "delivered_at",
        F.coalesce(F.col("is_water").cast("string"), F.lit("null")).alias("water"),
        F.coalesce(_multiset("pois", POI_FIELDS), F.array()).alias("__p"),
        F.coalesce(_multiset("ways", WAY_FIELDS), F.array()).alias("__w"),
    )
    parted = slim.select(*TILE_KEY, "delivered_at", "water", F.transform(zooms, part).alias("parts"))
    now = current_rows(parted, TILE_KEY, "delivered_at", ["water", F.to_json("parts")])
    tile = F.array(F.struct(F.lit(-1).alias("zi"), F.col("water").cast("binary").alias("value")))
    return now.select(*TILE_KEY, F.explode(F.concat(tile, "parts")).alias("part")).select(*TILE_KEY, "part.zi", "part.value")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = ("map_id", "from_snap", "to_snap", "si", "tile_x", "tile_y")
    residues = snapshot_residues(_tile_parts(table(spark, sf_dir, "tile_snapshot")), ["map_id"], "snap_no", ["si", "tile_x", "tile_y", "zi", "value"])
    labelled = label_changes(residues, [*tile, "zi"], "value")
    own = F.col("zi").eqNullSafe(-1)
    # per tile at most one row for the tile itself and one per zoom row: a bounded group
    per_tile = labelled.groupBy(*tile).agg(
        F.max(F.when(own, F.col("change"))).alias("whole"),
        F.collect_list(F.when(~own, F.struct(F.col("zi"), F.lit("content").alias("op")))).alias("content"),
    )
    one = lambda op: F.array(F.struct(F.lit(-1).alias("zi"), op.alias("op")))
    rows = (
        F.when(F.col("whole").isin("added", "removed"), one(F.col("whole")))
        .when(F.col("whole") == "changed", F.concat(one(F.lit("water")), "content"))
        .otherwise(F.col("content"))
    )
    return per_tile.select(*tile, F.inline(rows))


# -- p5: few tiles hold most features ------------------------------------------------------------


def _current_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, kind).select(
            F.lit(kind).alias("kind"),
            *FEATURE_KEY,
            F.coalesce(F.size("tags"), F.lit(0)).alias("n_tags"),
            F.col("feat_name").isNotNull().cast("int").alias("named"),
            "loaded_at",
        )
        for kind in ("poi", "way")
    ]
    return current_rows(parts[0].unionByName(parts[1]), ["kind", *FEATURE_KEY], "loaded_at", ["n_tags", "named"])


def p5_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and tile over all maps: current features, tag occurrences and named features."""
    measures = {"n_tags": F.col("n_tags"), "n_named": F.col("named")}
    return dense_key_sums(_current_features(spark, sf_dir), ["kind", "si", "tile_x", "tile_y"], measures, "n_features")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = p5_tiles(spark, sf_dir)
    totals = tiles.groupBy(F.col("kind").alias("__kind")).agg(F.sum("n_features").alias("__n"))  # one row per kind
    hot = tiles.join(totals, F.col("kind") == F.col("__kind")).where("n_features * 100 > __n")
    return hot.select("kind", "si", "tile_x", "tile_y")


# -- the same in SQL -----------------------------------------------------------------------------

_HEADERS = "select lower(trim(map_id)) map_id, creation_date, header_comment from {t} qualify row_number() over (partition by lower(trim(map_id)) order by written_at desc nulls last) = 1"
_TILES = """select lower(trim(map_id)) map_id, snap_no, si, tile_x, tile_y, is_water,
  list_sort(list_transform(ways, lambda e: struct_pack(a := e.zi_index, b := e.layer, c := e.sub_tile_bitmap, d := e.double_delta, e := e.feat_name,
    f := e.house_number, g := e.reference, h := e.label_lat, i := e.label_lon, j := e.blocks, k := list_sort(e.tags)))) ways
  from {t} qualify row_number() over (partition by lower(trim(map_id)), snap_no, si, tile_x, tile_y order by delivered_at desc nulls last) = 1"""

P2_SQL = f"""
with hb as ({_HEADERS.format(t="map_header")}), hc as ({_HEADERS.format(t="map_header_copy")}),
tb as ({_TILES.format(t="tile_snapshot")}), tc as ({_TILES.format(t="tile_snapshot_copy")}),
h as (select coalesce(hb.map_id, hc.map_id) map_id, list_filter([
    case when hc.map_id is null then 'missing_in_copy' when hb.map_id is null then 'missing_in_base' end,
    case when hb.map_id = hc.map_id and hb.creation_date is distinct from hc.creation_date then 'creation_date' end,
    case when hb.map_id = hc.map_id and hb.header_comment is distinct from hc.header_comment then 'header_comment' end], lambda x: x is not null) fs
  from hb full join hc on hb.map_id = hc.map_id),
t as (select coalesce(tb.map_id, tc.map_id) map_id, coalesce(tb.snap_no, tc.snap_no) snap_no, coalesce(tb.si, tc.si) si,
    coalesce(tb.tile_x, tc.tile_x) tile_x, coalesce(tb.tile_y, tc.tile_y) tile_y, list_filter([
    case when tc.map_id is null then 'missing_in_copy' when tb.map_id is null then 'missing_in_base' end,
    case when tb.map_id = tc.map_id and tb.is_water is distinct from tc.is_water then 'is_water' end,
    case when tb.map_id = tc.map_id and tb.ways is distinct from tc.ways then 'ways' end], lambda x: x is not null) fs
  from tb full join tc on tb.map_id = tc.map_id and tb.snap_no = tc.snap_no and tb.si = tc.si and tb.tile_x = tc.tile_x and tb.tile_y = tc.tile_y)
select 'map_header' rel, map_id, -1 snap_no, -1 si, -1 tile_x, -1 tile_y, unnest(fs) field from h
union all select 'tile_snapshot', map_id, snap_no, si, tile_x, tile_y, unnest(fs) from t
"""

P3_SQL = """
with cur as (select map_id, snap_no, si, tile_x, tile_y, is_water,
  list_sort(list_transform(pois, lambda e: struct_pack(z := e.zi_index, a := e.lat, b := e.lon, c := e.layer, d := e.feat_name, e := e.house_number,
    f := e.elevation, g := list_sort(e.tags)))) p,
  list_sort(list_transform(ways, lambda e: struct_pack(z := e.zi_index, b := e.layer, c := e.sub_tile_bitmap, d := e.double_delta, e := e.feat_name,
    f := e.house_number, g := e.reference, h := e.label_lat, i := e.label_lon, j := e.blocks, k := list_sort(e.tags)))) w
  from tile_snapshot qualify row_number() over (partition by map_id, snap_no, si, tile_x, tile_y order by delivered_at desc nulls last) = 1),
steps as (select map_id, snap_no, lead(snap_no) over (partition by map_id order by snap_no) nxt from (select distinct map_id, snap_no from cur)),
a as (select c.*, s.snap_no from_snap, s.nxt to_snap from cur c join steps s on c.map_id = s.map_id and c.snap_no = s.snap_no where s.nxt is not null),
b as (select c.*, s.snap_no from_snap, s.nxt to_snap from cur c join steps s on c.map_id = s.map_id and c.snap_no = s.nxt),
j as (select coalesce(a.map_id, b.map_id) map_id, coalesce(a.from_snap, b.from_snap) from_snap, coalesce(a.to_snap, b.to_snap) to_snap,
    coalesce(a.si, b.si) si, coalesce(a.tile_x, b.tile_x) tile_x, coalesce(a.tile_y, b.tile_y) tile_y,
    a.map_id is not null ha, b.map_id is not null hb, a.is_water wa, b.is_water wb, a.p pa, b.p pb, a.w va, b.w vb
  from a full join b on a.map_id = b.map_id and a.from_snap = b.from_snap and a.si = b.si and a.tile_x = b.tile_x and a.tile_y = b.tile_y),
z as (select *, unnest(list_distinct(list_concat(list_concat(list_transform(coalesce(pa, []), lambda e: e.z), list_transform(coalesce(pb, []), lambda e: e.z)),
    list_concat(list_transform(coalesce(va, []), lambda e: e.z), list_transform(coalesce(vb, []), lambda e: e.z))))) zi from j where ha and hb)
select map_id, from_snap, to_snap, si, tile_x, tile_y, -1 zi, case when ha then 'removed' else 'added' end op from j where ha <> hb
union all select map_id, from_snap, to_snap, si, tile_x, tile_y, -1, 'water' from j where ha and hb and wa is distinct from wb
union all select map_id, from_snap, to_snap, si, tile_x, tile_y, zi, 'content' from z
  where list_filter(coalesce(pa, []), lambda e: e.z = zi) is distinct from list_filter(coalesce(pb, []), lambda e: e.z = zi)
     or list_filter(coalesce(va, []), lambda e: e.z = zi) is distinct from list_filter(coalesce(vb, []), lambda e: e.z = zi)
"""

_FEATURES = """with f as (select 'poi' kind, si, tile_x, tile_y, tags, feat_name from poi
  qualify row_number() over (partition by map_id, si, tile_x, tile_y, zi, ord order by loaded_at desc nulls last) = 1
union all select 'way', si, tile_x, tile_y, tags, feat_name from way
  qualify row_number() over (partition by map_id, si, tile_x, tile_y, zi, ord order by loaded_at desc nulls last) = 1)
"""
P5_TILES_SQL = (
    _FEATURES
    + """select kind, si, tile_x, tile_y, count(*)::bigint n_features, sum(coalesce(len(tags), 0))::bigint n_tags, count(feat_name)::bigint n_named
from f group by all"""
)
P5_SQL = (
    _FEATURES
    + """select t.kind, t.si, t.tile_x, t.tile_y from (select kind, si, tile_x, tile_y, count(*) c from f group by kind, si, tile_x, tile_y) t
join (select kind, count(*) n from f group by kind) k on t.kind = k.kind where 100 * t.c > k.n"""
)

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_tiles": p5_tiles}
ORACLES = {"p2_found": P2_SQL, "p3_found": P3_SQL, "p5_found": P5_SQL, "p5_tiles": P5_TILES_SQL}
