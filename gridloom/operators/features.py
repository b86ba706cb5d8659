"""Feature operators: equality keys, multiset differences, orders, digests, deltas of coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.schemas import FEATURE_VALUE, TILE_COLUMNS

ROW = (*TILE_COLUMNS, "zoom", "kind")


def _compat_fields(kind: str) -> Column:
    """The fields the old comparison looks at: a name or house number ends it, encoding is not seen."""
    if kind == "poi":
        named, housed = F.col("name").isNotNull(), F.col("house_number").isNotNull()
        return F.struct(
            "layer", "lon", "lat", F.array_sort("tags").alias("tags"), "name",
            F.when(~named, F.col("house_number")).alias("house_number"), F.when(~named & ~housed, F.col("elevation")).alias("elevation"),
        )
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "house_number", "reference")]
    return F.struct("layer", "label_lat", "label_lon", F.array_sort("tags").alias("tags"), *text, "blocks", "sub_tile_bitmap")


def value_key(mode: str = "canonical", strict_tags: bool = False) -> Column:
    """A text that is equal for equal features. ``compat`` compares fewer fields; ``strict_tags`` minds tag order."""
    if mode == "compat":
        return F.when(F.col("kind") == "poi", F.to_json(_compat_fields("poi"))).otherwise(F.to_json(_compat_fields("way")))
    tags = F.col("tags") if strict_tags else F.array_sort("tags")
    return F.to_json(F.struct(*(tags.alias(c) if c == "tags" else F.col(c) for c in FEATURE_VALUE)))


def element_counts(features: DataFrame, mode: str = "canonical", strict_tags: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct features of each zoom row with their number; ``digest`` stands for the feature."""
    keyed = features.select(*extra, *ROW, F.sha2(value_key(mode, strict_tags).cast("binary"), 256).alias("digest"))
    return keyed.groupBy(*extra, *ROW, "digest").agg(F.count("*").alias("n"))


def bag_difference(old: DataFrame, new: DataFrame, mode: str = "canonical", strict_tags: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Features that occur more often on one side: ``change`` - or + and how often (n)."""
    a = element_counts(old, mode, strict_tags, extra).withColumn("n", -F.col("n"))
    net = a.unionByName(element_counts(new, mode, strict_tags, extra)).groupBy(*extra, *ROW, "digest").agg(F.sum("n").alias("net"))
    return net.where("net <> 0").select(*extra, *ROW, "digest", F.when(F.col("net") < 0, "-").otherwise("+").alias("change"), F.abs("net").alias("n"))


def portable_hash(text: Column) -> Column:
    """60 bits of MD5 as a bigint; the same number in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def tile_digests(hashed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Order-insensitive fingerprint of each group of the column ``h``, seeded with the count."""
    total = F.sum(F.col("h").cast("decimal(38,0)")) + F.count("*")
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), (total % F.lit(2**61 - 1).cast("decimal(38,0)")).cast("bigint").alias("digest"))


def map_digest(tiles: DataFrame, digest: str = "digest") -> DataFrame:
    """map_id, digest: SHA-256 over the tile digests in (si, x, y, zoom, kind) order.

    First one digest per (map, si, x), then one over these: no group holds more than one column of tiles.
    """
    line = F.concat_ws("/", "y", "zoom", "kind", "n", digest)
    column = tiles.groupBy("map_id", "si", "x").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "zoom", "kind", line.alias("line")))), lambda r: r["line"]), "\n").cast("binary"), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("si", "x", "d"))), lambda r: r["d"]), "\n")
    return column.groupBy("map_id").agg(F.sha2(whole.cast("binary"), 256).alias("digest"))


def zoom_row_counts(features: DataFrame) -> DataFrame:
    """Number of points and ways of each tile and zoom level."""
    return features.groupBy(*TILE_COLUMNS, "zoom").agg(
        F.count(F.when(F.col("kind") == "poi", 1)).alias("n_pois"), F.count(F.when(F.col("kind") == "way", 1)).alias("n_ways")
    )


def canonical_rank(features: DataFrame) -> DataFrame:
    """Place of each feature in its zoom row under a total order: layer first, then position, tags and the rest."""
    order = ["layer", "lon", "lat", "sorted_tags", "name", "house_number", "elevation", "reference", "sub_tile_bitmap", "ord"]
    w = Window.partitionBy(*ROW).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return features.withColumn("sorted_tags", F.array_join(F.array_sort("tags"), "\u0001")).withColumn("rank", F.row_number().over(w).cast("bigint"))


def absolute_nodes(nodes: DataFrame) -> DataFrame:
    """Positions relative to the tile (column ``i`` is the node's place in its segment).

    Single deltas are summed up once. With ``double_delta`` the nodes after the first hold changes of
    the step, so their running sums are summed up again; without the flag (null) deltas are single.
    """
    w = Window.partitionBy(*(c for c in nodes.columns if c not in ("i", "dlat", "dlon"))).orderBy("i")
    double = F.col("double_delta") & (F.col("i") > 0)
    for c in ("lat", "lon"):
        step = F.sum(F.when(double, F.col(f"d{c}"))).over(w)
        nodes = nodes.withColumn(f"__{c}", F.when(double, step).otherwise(F.col(f"d{c}")))
    return nodes.withColumn("lat", F.sum("__lat").over(w)).withColumn("lon", F.sum("__lon").over(w)).drop("__lat", "__lon")


def delta_coded(tiles: DataFrame) -> DataFrame:
    """dy, dx of tiles in (si, y, x) order: y against the row before, x against the tile before in the row."""
    in_map = Window.partitionBy("map_id", "si").orderBy("y", "x")
    before_y, before_x = F.lag("y").over(in_map), F.lag("x").over(in_map)
    return tiles.withColumn("dy", F.col("y") - F.coalesce(before_y, F.lit(0))).withColumn("dx", F.when(before_y == F.col("y"), F.col("x") - before_x).otherwise(F.col("x")))


def delta_decoded(coded: DataFrame) -> DataFrame:
    """The inverse of :func:`delta_coded`; rows are numbered by ``i`` in their map and interval."""
    w = Window.partitionBy("map_id", "si").orderBy("i")
    y = F.sum("dy").over(w)
    rows = coded.withColumn("y", y)
    return rows.withColumn("x", F.sum("dx").over(Window.partitionBy("map_id", "si", "y").orderBy("i")))
