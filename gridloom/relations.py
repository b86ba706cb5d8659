"""The map relations, read from the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schemas import FEATURE, FEATURE_COLUMNS
from gridloom.tables import FEATURE_KEY, TILE_KEY, current_rows, folded, table

_TYPES = dict(x.strip().split(" ", 1) for x in FEATURE.replace("\n", " ").split(", "))


def _feature_columns(given: dict[str, Column]) -> list[Column]:
    """All feature columns, those not given as nulls of their type."""
    return [(given[c] if c in given else F.lit(None)).cast(_TYPES[c]).alias(c) for c in FEATURE_COLUMNS]


def headers(spark: SparkSession, sf_dir: str, name: str = "map_header") -> DataFrame:
    """The current header of each map."""
    h = table(spark, sf_dir, name)
    now = current_rows(h, ["map_id"], "written_at")
    intervals = F.transform(
        "zoom_intervals",
        lambda z: F.struct(
            z["si"].alias("si"), z["base_zoom"].alias("base"), z["min_zoom"].alias("min"), z["max_zoom"].alias("max"), z["pos"].alias("pos"), z["byte_size"].alias("size")
        ),
    )
    return now.select(
        folded("map_id").alias("map_id") if name.endswith("_copy") else F.col("map_id"), "file_version", F.col("file_size").cast("decimal(20,0)").alias("file_size"), "creation_date",
        "min_lat", "min_lon", "max_lat", "max_lon", "tile_size", "projection", "has_debug", "start_lat", "start_lon", "start_zoom",
        F.col("language_preference").alias("language"), F.col("header_comment").alias("comment"), "created_by", "poi_tags", "way_tags", intervals.alias("zoom_intervals"),
    )


def features(spark: SparkSession, sf_dir: str, merge: bool = False) -> DataFrame:
    """Current poi and way rows, with tag strings as written in the map's dictionary and absolute zoom.

    ``merge``: dictionaries are sorted and merged, never broadcast, whatever Spark takes their size for.
    """
    h = headers(spark, sf_dir)
    both = F.array(*(F.struct(F.lit(k).alias("__kind"), F.col(f"{k}_tags").alias("__dict")) for k in ("poi", "way")))
    dicts = h.select(F.col("map_id").alias("__map"), F.col("zoom_intervals").alias("__zi"), F.inline(both))
    dicts = dicts.hint("merge") if merge else dicts
    common = [*FEATURE_KEY, "layer", "tags", "feat_name", "house_number", "loaded_at"]
    own = {"poi": ["lat_diff", "lon_diff", "elevation"], "way": ["sub_tile_bitmap", "reference", "label_lat", "label_lon", "double_delta", "blocks"]}
    parts = [table(spark, sf_dir, k).select(F.lit(k).alias("kind"), *common, *own[k]) for k in own]
    raw = parts[0].unionByName(parts[1], allowMissingColumns=True)
    now = current_rows(raw, ["kind", *FEATURE_KEY], "loaded_at")
    j = now.join(dicts, (F.col("map_id") == F.col("__map")) & (F.col("kind") == F.col("__kind")), "left")
    tags = F.array_compact(F.transform("tags", lambda t: F.get("__dict", t.try_cast("int"))))
    lowest = F.filter("__zi", lambda z: z["si"] == F.col("si"))[0]["min"]
    given = {c: F.col(c) for c in ("map_id", "si", "kind", "ord", "layer", "house_number", "elevation", "reference", "label_lat", "label_lon", "sub_tile_bitmap", "blocks")}
    given |= {"x": F.col("tile_x"), "y": F.col("tile_y"), "zoom": F.col("zi") + lowest, "lat": F.col("lat_diff"), "lon": F.col("lon_diff")}
    given |= {"tags": tags, "name": F.col("feat_name"), "encoding": F.col("double_delta")}
    return j.select(*_feature_columns(given))


def snapshot_tiles(spark: SparkSession, sf_dir: str, name: str = "tile_snapshot") -> DataFrame:
    """The current tiles of each delivery: map_id, version, si, x, y, is_water and the nested features."""
    df = table(spark, sf_dir, name)
    df = df.withColumn("map_id", folded("map_id"))
    now = current_rows(df, TILE_KEY, "delivered_at")
    return now.select("map_id", F.col("snap_no").alias("version"), "si", F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), "is_water", "first_way_offset", "pois", "ways")


def snapshot_features(tiles: DataFrame) -> DataFrame:
    """version and the feature columns of every poi and way in :func:`snapshot_tiles`."""
    place = ["map_id", "version", "si", "x", "y"]
    out = []
    for kind, nested in (("poi", "pois"), ("way", "ways")):
        e = tiles.select(*place, F.posexplode(nested).alias("__ord", "e"))
        given = {c: F.col(c) for c in ("map_id", "si", "x", "y")} | {"kind": F.lit(kind), "ord": F.col("__ord"), "zoom": F.col("e.zi_index"), "layer": F.col("e.layer")}
        given |= {"tags": F.col("e.tags"), "name": F.col("e.feat_name"), "house_number": F.col("e.house_number")}
        if kind == "poi":
            given |= {"lat": F.col("e.lat"), "lon": F.col("e.lon"), "elevation": F.col("e.elevation")}
        else:
            given |= {c: F.col(f"e.{c}") for c in ("sub_tile_bitmap", "reference", "label_lat", "label_lon", "blocks")} | {"encoding": F.col("e.double_delta")}
        out.append(e.select("version", *_feature_columns(given)))
    return out[0].unionByName(out[1])
