"""Header operators: edits, comparison, boxes, zoom intervals and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.mercator import degrees, tile_x, tile_y

#: Fields that decide whether two headers are equal; the last two may be ignored.
COMPARED = ("min_lat", "min_lon", "max_lat", "max_lon", "tile_size", "projection", "start_zoom", "language", "created_by", "comment", "creation_date")
BBOX = ("min_lat", "min_lon", "max_lat", "max_lon")


def edit_header(header: DataFrame, comment: str | None = None, creation_date: int | None = None) -> DataFrame:
    """Sets the comment and / or the creation date (ms); bodies are not touched. At least one is needed."""
    if comment is None and creation_date is None:
        raise ValueError("nothing to edit: give a comment or a creation date")
    if comment is not None:
        header = header.withColumn("comment", F.lit(comment))
    if creation_date is not None:
        header = header.withColumn("creation_date", F.lit(str(creation_date)).cast("decimal(20,0)"))
    return header


def header_diff(old: DataFrame, new: DataFrame, ignore_comment: bool = False, ignore_timestamp: bool = False) -> DataFrame:
    """map_id, field, old_value, new_value for every differing field; a map on one side only has field ``missing``."""
    fields = [f for f in COMPARED if not (ignore_comment and f == "comment") and not (ignore_timestamp and f == "creation_date")]

    def unpivoted(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields), F.struct(F.lit("missing").alias("field"), F.lit("no").alias(name)))
        return df.select("map_id", F.inline(pairs))

    joined = unpivoted(old, "old_value").join(unpivoted(new, "new_value"), ["map_id", "field"], "full_outer")
    one_sided = F.col("field") == "missing"
    here = F.coalesce(F.col("old_value"), F.lit("yes")), F.coalesce(F.col("new_value"), F.lit("yes"))
    missing = joined.where(one_sided & (here[0] != here[1])).select("map_id", "field", here[0].alias("old_value"), here[1].alias("new_value"))
    gone = missing.select("map_id")
    changed = joined.where(~one_sided & ~F.col("old_value").eqNullSafe(F.col("new_value"))).join(gone, "map_id", "left_anti")
    return changed.select("map_id", "field", "old_value", "new_value").unionByName(missing)


def intervals(header: DataFrame) -> DataFrame:
    """map_id, si, base, min, max, pos, size, has_debug: one row per zoom interval."""
    return header.select("map_id", "has_debug", *BBOX, F.inline("zoom_intervals"))


def same_intervals(old: DataFrame, new: DataFrame) -> DataFrame:
    """map_id, same: whether both versions have the same zoom intervals; only then tiles compare."""
    shape = lambda df, n: df.select("map_id", F.transform("zoom_intervals", lambda z: F.struct(z["base"], z["min"], z["max"])).alias(n))
    return shape(old, "a").join(shape(new, "b"), "map_id").select("map_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def subfile_of_base(header: DataFrame, base: int | Column) -> DataFrame:
    """map_id, si: the first interval with this base zoom."""
    return intervals(header).where(F.col("base") == base).groupBy("map_id").agg(F.min("si").alias("si"))


def subfile_containing(header: DataFrame, zoom: int | Column) -> DataFrame:
    """map_id, si: the first interval whose range holds the zoom."""
    return intervals(header).where((F.col("min") <= zoom) & (F.col("max") >= zoom)).groupBy("map_id").agg(F.min("si").alias("si"))


def grids(header: DataFrame) -> DataFrame:
    """map_id, si, base, x0, y0, x1, y1, width, n_tiles: the tile grid of each interval."""
    g = intervals(header).select(
        "map_id", "si", "base", "has_debug",
        tile_x(degrees("min_lon"), "base").alias("x0"), tile_y(degrees("max_lat"), "base").alias("y0"),
        tile_x(degrees("max_lon"), "base").alias("x1"), tile_y(degrees("min_lat"), "base").alias("y1"),
    )
    return g.withColumn("width", F.col("x1") - F.col("x0") + 1).withColumn("n_tiles", F.col("width") * (F.col("y1") - F.col("y0") + 1))


def grid_tiles(grid: DataFrame) -> DataFrame:
    """Every tile of the grids, row by row; rows are made in the tasks, two generators deep."""
    rows = grid.select("map_id", "si", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y"))
    return rows.select("map_id", "si", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def bbox_union(header: DataFrame, with_data: DataFrame | None = None) -> DataFrame:
    """The box around all maps, or around those listed in ``with_data`` (map_id)."""
    h = header if with_data is None else header.join(with_data.select("map_id").distinct(), "map_id", "left_semi")
    return h.agg(F.min("min_lat").alias("min_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lat").alias("max_lat"), F.max("max_lon").alias("max_lon"))


def bbox_intersection(header: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """map_id and the part of each map's box inside ``box`` (micro-degrees); maps outside are left out."""
    lo_lat, lo_lon, hi_lat, hi_lon = map(F.lit, box)
    cut = header.select(
        "map_id", F.greatest("min_lat", lo_lat).alias("min_lat"), F.greatest("min_lon", lo_lon).alias("min_lon"),
        F.least("max_lat", hi_lat).alias("max_lat"), F.least("max_lon", hi_lon).alias("max_lon"),
    )
    return cut.where("min_lat <= max_lat and min_lon <= max_lon")
