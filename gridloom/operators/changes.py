"""Comparing and updating versions: tile diffs, change logs, ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.features import bag_difference, value_key
from gridloom.schemas import TILE_COLUMNS

TILE_ROW = (*TILE_COLUMNS, "zoom", "kind")


def tile_presence(old: DataFrame, new: DataFrame, keys: Sequence[str] = TILE_COLUMNS, how: str = "full_outer") -> DataFrame:
    """Both versions' tiles side by side: in_old, in_new, old_water, new_water."""
    a = old.select(*keys, F.col("is_water").alias("old_water"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.col("is_water").alias("new_water"), F.lit(True).alias("__b"))
    j = a.join(b, list(keys), how)
    return j.select(*keys, F.col("__a").isNotNull().alias("in_old"), F.col("__b").isNotNull().alias("in_new"), "old_water", "new_water")


def tile_diff(old_tiles: DataFrame, new_tiles: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str] = TILE_COLUMNS) -> DataFrame:
    """Per differing tile: existence, water flag, features only in old and only in new.

    The multiset difference of features is one aggregation; tiles without any difference never reach
    the final join with more than their key.
    """
    extra = [k for k in keys if k not in TILE_COLUMNS]
    sides = bag_difference(old, new, extra=extra).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("change") == "-", F.col("n"))), F.lit(0)).alias("n_removed"),
        F.coalesce(F.sum(F.when(F.col("change") == "+", F.col("n"))), F.lit(0)).alias("n_added"),
    )
    both = tile_presence(old_tiles, new_tiles, keys)
    water = F.col("in_old") & F.col("in_new") & ~F.col("old_water").eqNullSafe(F.col("new_water"))
    full = both.join(sides, list(keys), "left").withColumn("water_differs", water)
    changed = (F.col("in_old") != F.col("in_new")) | F.col("water_differs") | F.col("n_removed").isNotNull()
    zero = F.lit(0).cast("bigint")
    return full.where(changed).select(*keys, "in_old", "in_new", "water_differs", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_added", zero).alias("n_added"))


def value_counts(features: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Each distinct feature of a zoom row, as JSON, with its number."""
    return features.select(*extra, *TILE_ROW, value_key().alias("value")).groupBy(*extra, *TILE_ROW, "value").agg(F.count("*").alias("n"))


def change_log(old: DataFrame, new: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Row-level delta: ``net`` copies of ``value`` to add (or, below zero, to remove) per zoom row."""
    a = value_counts(old, extra).withColumn("n", -F.col("n"))
    net = a.unionByName(value_counts(new, extra)).groupBy(*extra, *TILE_ROW, "value").agg(F.sum("n").alias("net"))
    return net.where("net <> 0")


def apply_logs(base: DataFrame, *logs: DataFrame) -> DataFrame:
    """The feature counts after all logs, in one aggregation whatever the length of the chain.

    Each log holds differences of counts, so their order does not matter and no barrier is needed
    between versions.
    """
    counts = value_counts(base).withColumnRenamed("n", "net")
    for log in logs:
        counts = counts.unionByName(log.select(*counts.columns))
    total = counts.groupBy(*TILE_ROW, "value").agg(F.sum("net").alias("n"))
    return total.where("n > 0")


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The greatest version of each key."""
    return rows.groupBy(*keys).agg(F.max(version).alias(version))


def stale(rows: DataFrame, present: DataFrame, entity: Sequence[str], tile: Sequence[str], version: str) -> DataFrame:
    """Rows after whose version some later version of the entity lacks the tile.

    A tile present in every later version has as many later rows as the entity has later versions, so
    two counts per row decide and nothing is joined version by version.
    """
    tiles = present.select(*entity, *tile, version).distinct()
    rank = F.row_number().over(Window.partitionBy(*entity, *tile).orderBy(F.desc(version)))
    later_rows = tiles.withColumn("__later_rows", rank - 1)
    versions = present.select(*entity, version).distinct()
    later = versions.withColumn("__later", F.row_number().over(Window.partitionBy(*entity).orderBy(F.desc(version))) - 1)
    j = later_rows.join(later, [*entity, version]).where("__later_rows < __later").select(*entity, *tile, version)
    return rows.join(j, [*entity, *tile, version], "left_semi")
