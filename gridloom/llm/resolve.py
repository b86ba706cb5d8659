"""Map features with their tags resolved to map-independent term ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.tables import FEATURE_KEY, current_rows, folded, table

KINDS = ("poi", "way")


def term_id(term: Column) -> Column:
    """A 64-bit id of a term; null stays null. :func:`dictionary_terms` refuses colliding ids."""
    return F.when(term.isNotNull(), F.xxhash64(term))


def current_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, kind, terms: the folded dictionary of each map's current header, in id order."""
    headers = table(spark, sf_dir, "map_header").select("map_id", "poi_tags", "way_tags", "written_at")
    now = current_rows(headers, ["map_id"], "written_at", [F.xxhash64("poi_tags", "way_tags")])
    both = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_tags").alias("tags")) for k in KINDS))
    return now.select("map_id", F.inline(both)).select("map_id", "kind", F.transform("tags", folded).alias("terms"))


def dictionary_terms(dictionaries: DataFrame) -> DataFrame:
    """kind, id, term: every distinct term of the dictionaries.

    Two terms of one id would be counted as one, so such a pair ends the query with an error.
    """
    terms = dictionaries.select("kind", F.explode("terms").alias("term")).where("term is not null")
    ids = terms.groupBy("kind", term_id(F.col("term")).alias("id")).agg(F.min("term").alias("term"), F.max("term").alias("__last"))
    clash = F.raise_error(F.concat(F.lit("two terms share an id: "), "term", F.lit(" and "), "__last"))
    return ids.select("kind", "id", F.when(F.col("term") == F.col("__last"), F.col("term")).otherwise(clash).alias("term"))


def current_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, ids: one row per current feature; ids lists the term of every tag, null where it has none.

    The join on map_id may be skewed by a large map; it feeds no further grouping by map, so Spark's
    adaptive execution is free to split such a partition.
    """
    parts = [table(spark, sf_dir, k).select(F.lit(k).alias("kind"), *FEATURE_KEY, "tags", "loaded_at") for k in KINDS]
    now = current_rows(parts[0].unionByName(parts[1]), ["kind", *FEATURE_KEY], "loaded_at", [F.xxhash64("tags")])
    ids = current_dictionaries(spark, sf_dir).select(
        F.col("map_id").alias("__map"), F.col("kind").alias("__kind"), F.transform("terms", term_id).alias("dictionary")
    )
    joined = now.join(ids, (F.col("map_id") == F.col("__map")) & (F.col("kind") == F.col("__kind")), "left")
    # ids outside the dictionary, negative ones and nulls resolve to null
    found = F.transform("tags", lambda t: F.get("dictionary", t.try_cast("int")))
    return joined.select("kind", found.alias("ids"))
