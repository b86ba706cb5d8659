"""The input tables: where they lie, their keys, and which of a key's rows is the current one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURE_KEY = ("map_id", "si", "tile_x", "tile_y", "zi", "ord")
TILE_KEY = ("map_id", "snap_no", "si", "tile_x", "tile_y")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, keys: Sequence[str | Column], at: str, ties: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key: the one with the greatest ``at`` (null is the least).

    Keys may be null; null is a key value like any other. Rows that tie on ``at`` are ordered by
    ``ties``, so a result does not depend on the order of the input; exact duplicates need no ties.
    The filter on ``row_number`` lets Spark drop replaced rows of a key before the shuffle already
    (WindowGroupLimit), so a key with very many copies does not load one task.
    """
    order = [F.col(at).desc_nulls_last(), *(F.col(t) if isinstance(t, str) else t for t in ties)]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def folded(name: str | Column) -> Column:
    """Trimmed and lower-cased, the way map ids and tags are compared."""
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
