"""Tag operators: statistics by zoom, ranked dictionaries, dictionary maps, unmapped features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What ``appear`` says for a tag no feature carries.
UNUSED = 9999


def tag_counts(features: DataFrame, by: Sequence[str] = ("map_id",)) -> DataFrame:
    """Occurrences of each tag per zoom level."""
    return features.select(*by, "kind", "zoom", F.explode("tags").alias("tag")).groupBy(*by, "kind", "tag", "zoom").agg(F.count("*").alias("n"))


def tag_stats(counts: DataFrame, dictionary: DataFrame, by: Sequence[str] = ("map_id",)) -> DataFrame:
    """count and lowest zoom (``appear``) of every dictionary tag, unused ones with 0 and 9999."""
    used = counts.groupBy(*by, "kind", "tag").agg(F.sum("n").alias("count"), F.min("zoom").alias("appear"))
    listed = dictionary.where("tag is not null").select(*by, "kind", "tag").distinct()
    return listed.join(used, [*by, "kind", "tag"], "left").select(
        *by, "kind", "tag", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.coalesce("appear", F.lit(UNUSED)).alias("appear")
    )


def zoom_pivot(counts: DataFrame, zooms: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One column z<zoom> per zoom level; any number of levels."""
    p = counts.groupBy(*by, "kind", "tag")
    return p.agg(*(F.coalesce(F.sum(F.when(F.col("zoom") == z, F.col("n"))), F.lit(0)).cast("bigint").alias(f"z{z}") for z in zooms))


def rounded(n: Column) -> Column:
    """Rounded down to one significant digit."""
    power = F.pow(F.lit(10), F.length(n.cast("string")) - 1).cast("bigint")
    return n - n % power


def ranked_dictionary(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """New tag ids: most frequent first, ties by name. Only counts reach the ranking window."""
    counts = features.select(*by, "kind", F.explode("tags").alias("tag")).groupBy(*by, "kind", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "kind").orderBy(F.desc("n"), "tag")
    return counts.select(*by, "kind", "tag", "n", (F.row_number().over(w) - 1).cast("bigint").alias("tag_id"))


def dictionary(header: DataFrame, by: Sequence[str] = ("map_id",)) -> DataFrame:
    """by, kind, tag_id, tag from the headers."""
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_tags").alias("tags")) for k in ("poi", "way")))
    d = header.select(*by, F.inline(both))
    return d.select(*by, "kind", F.posexplode("tags").alias("tag_id", "tag")).withColumn("tag_id", F.col("tag_id").cast("bigint"))


def dictionary_versions(headers: Mapping[str, DataFrame]) -> DataFrame:
    """ver, map_id, kind, tag_id, tag of all versions, and per version ``<ver>_id``: the last id it gives the tag, null if it lacks it.

    Equal tags meet in one window over all versions, not in joins: Spark judges a side of a join by its
    files, and a dictionary that unfolds to many times their size would be broadcast. Headers are
    shuffled while their tags are arrays still. A null map or tag equals none.
    """
    each = (h.select(F.lit(v).alias("ver"), "map_id", "poi_tags", "way_tags") for v, h in headers.items())
    d = dictionary(reduce(DataFrame.unionByName, each).repartition("map_id"), ("ver", "map_id"))
    keys = ("map_id", "kind", "tag")
    w = Window.partitionBy(F.xxhash64(*keys), *keys)  # the hash makes sorting cheap
    known = F.col("map_id").isNotNull() & F.col("tag").isNotNull()
    return d.select("*", *(F.when(known, F.max(F.when(F.col("ver") == v, F.col("tag_id"))).over(w)).alias(f"{v}_id") for v in headers))


def cross_version_map(versions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Old id to new id between any two of the versions, each with itself too."""
    to = F.array(*(F.struct(F.lit(v).alias("to_ver"), F.col(f"{v}_id").alias("new_id")) for v in names))
    return versions.select(F.col("ver").alias("from_ver"), "map_id", "kind", F.col("tag_id").alias("old_id"), "tag", F.inline(to))


def tag_map(versions: DataFrame, old: str, new: str) -> DataFrame:
    """Old id to new id by tag string; null where the new dictionary lacks the tag."""
    return versions.where(F.col("ver") == old).select("map_id", "kind", F.col("tag_id").alias("old_id"), "tag", F.col(f"{new}_id").alias("new_id"))


def tag_map_facts(mapped: DataFrame) -> DataFrame:
    """Per map and kind: is the map the identity, does it lose tags."""
    return mapped.groupBy("map_id", "kind").agg(
        F.bool_and(F.col("new_id").eqNullSafe(F.col("old_id"))).alias("is_identity"), F.bool_or(F.col("new_id").isNull()).alias("loses_tags")
    )


def tag_diff(versions: DataFrame, old: str, new: str) -> DataFrame:
    """The new dictionary as references: ref = old id + 1, or 0 with the tag as literal."""
    o = F.col(f"{old}_id")
    ref = F.coalesce(o + 1, F.lit(0)).cast("bigint")
    return versions.where(F.col("ver") == new).select("map_id", "kind", "tag_id", ref.alias("ref"), F.when(o.isNull(), F.col("tag")).alias("literal"))


def tag_diff_decoded(diff: DataFrame, old: DataFrame) -> DataFrame:
    """The dictionary a tag diff stands for, given the headers before, whose tags stay arrays and are not broadcast either."""
    o = old.select("map_id", "poi_tags", "way_tags").hint("merge")
    listed = F.when(F.col("kind") == "poi", F.col("poi_tags")).otherwise(F.col("way_tags"))
    tag = F.coalesce("literal", F.get(listed, (F.col("ref") - 1).cast("int")))
    return diff.join(o, "map_id", "left").select("map_id", "kind", "tag_id", tag.alias("tag"))


def split_by_dictionary(features: DataFrame, versions: DataFrame, own: str, allowed: str) -> DataFrame:
    """Adds ``mapped``: every tag of the feature is in the dictionary ``allowed``. Features with no tags are mapped.

    ``own`` is the version the features' tags come from. What it has and ``allowed`` lacks is found
    dictionary against dictionary, so a feature meets only the lost tags; these are as many as the
    dictionaries have where a map is missing, and are not broadcast.
    """
    keys = ["map_id", "kind"]
    lost = versions.where((F.col("ver") == own) & F.col("tag").isNotNull() & F.col(f"{allowed}_id").isNull())
    sets = lost.groupBy(*keys).agg(F.collect_set("tag").alias("__lost"))
    j = features.join(sets.hint("merge"), keys, "left")
    return j.withColumn("mapped", ~F.coalesce(F.arrays_overlap("tags", "__lost"), F.lit(False))).drop("__lost")


def erased_rows(split: DataFrame, row: Sequence[str]) -> DataFrame:
    """Zoom rows all of whose features carry an unmapped tag."""
    return split.groupBy(*row).agg(F.count("*").alias("n"), F.count(F.when(F.col("mapped"), 1)).alias("kept")).where("kept = 0").drop("kept")
