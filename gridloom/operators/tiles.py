"""Tile-index operators: lengths, offsets, existence, coverage, crops and size estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.headers import grids

#: Bytes of one index entry, and of the index signature of a debug map.
ENTRY_BYTES, SIGNATURE_BYTES = 5, 16


def _in_order():
    return Window.partitionBy("map_id", "si").orderBy("y", "x")


def lengths_from_offsets(tiles: DataFrame) -> DataFrame:
    """length = next offset - offset, the sub-file's size (column ``size``) ending the last tile."""
    return tiles.withColumn("length", F.coalesce(F.lead("offset").over(_in_order()), F.col("size")) - F.col("offset"))


def offsets_from_lengths(tiles: DataFrame, start: str = "data_start") -> DataFrame:
    """offset = start + the lengths of all earlier tiles; empty tiles get the next tile's offset."""
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("offset", F.col(start) + F.coalesce(F.sum("length").over(before), F.lit(0)))


def non_empty(tiles: DataFrame) -> DataFrame:
    return tiles.where("length > 0")


def subfiles_with_data(tiles: DataFrame) -> DataFrame:
    """map_id, si, has_data."""
    return tiles.groupBy("map_id", "si").agg(F.bool_or(F.col("length") > 0).alias("has_data"))


def covered_by(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Tiles that lie in the grid of any map of the same interval.

    Grids are cut into columns of tiles and the overlapping ranges of a column are merged, so the
    semi-join is keyed by (si, x) and its work grows with the widths of the grids, not with
    tiles x maps.
    """
    g = grid.where("x0 <= x1 and y0 <= y1").select(F.col("si").alias("__si"), F.explode(F.sequence("x0", "x1")).alias("__x"), "y0", "y1").distinct()
    column = Window.partitionBy("__si", "__x").orderBy("y0", "y1")
    reached = F.max("y1").over(column.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("opens", F.when(F.col("y0") > reached + 1, 1).otherwise(0)).withColumn("range", F.sum("opens").over(column))
    g = g.groupBy("__si", "__x", "range").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return tiles.join(g, (F.col("si") == F.col("__si")) & (F.col("x") == F.col("__x")) & F.col("y").between(F.col("y0"), F.col("y1")), "left_semi")


def in_grid(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Tiles inside their own map's grid."""
    g = grid.select(F.col("map_id").alias("__map"), F.col("si").alias("__si"), "x0", "y0", "x1", "y1")
    on = (F.col("map_id") == F.col("__map")) & (F.col("si") == F.col("__si"))
    return tiles.join(g, on & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")), "left_semi")


def single_tile(tiles: DataFrame, si: int, x: int, y: int) -> DataFrame:
    return tiles.where((F.col("si") == si) & (F.col("x") == x) & (F.col("y") == y))


def size_estimate(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """map_id, n_tiles, data_bytes, index_bytes: what the tiles in their grid take (headers not counted)."""
    data = in_grid(tiles, grid).groupBy("map_id").agg(F.sum("length").alias("data_bytes"))
    index = grid.groupBy("map_id").agg(
        F.sum("n_tiles").cast("bigint").alias("n_tiles"),
        F.sum(F.lit(ENTRY_BYTES) * F.col("n_tiles") + F.when(F.col("has_debug"), SIGNATURE_BYTES).otherwise(0)).cast("bigint").alias("index_bytes"),
    )
    return index.join(data, "map_id", "left").select("map_id", "n_tiles", F.coalesce("data_bytes", F.lit(0)).alias("data_bytes"), "index_bytes")


def cropped_header(header: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Headers cut to the box; maps outside are left out."""
    from gridloom.operators.headers import BBOX, bbox_intersection

    return header.drop(*BBOX).join(bbox_intersection(header, box), "map_id").select(*header.columns)


def crop(header: DataFrame, tiles: DataFrame, box: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Header and tiles of the part inside the box. Tiles stay whole; features are not clipped."""
    h = cropped_header(header, box)
    return h, in_grid(tiles, grids(h))
