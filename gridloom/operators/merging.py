"""Merging maps: union of features, water by agreement, one ranked dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_features(*features: DataFrame) -> DataFrame:
    """All features of all inputs; equal ones are kept as often as they come."""
    return reduce(lambda a, b: a.unionByName(b), features)


def merged_water(tiles: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Per tile over all maps: water only if every map that has the tile says so; uncovered tiles are land."""
    water = tiles.groupBy("si", "x", "y").agg(F.coalesce(F.bool_and("is_water"), F.lit(False)).alias("is_water"), F.countDistinct("map_id").alias("n_maps"))
    if grid is None:
        return water
    filled = grid.select("si", "x", "y").join(water, ["si", "x", "y"], "left")
    return filled.select("si", "x", "y", F.coalesce("is_water", F.lit(False)).alias("is_water"), F.coalesce("n_maps", F.lit(0).cast("bigint")).alias("n_maps"))
