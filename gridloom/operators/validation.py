"""Constraint checks over the relations: one row per violation, rule by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _violations(df: DataFrame, rule: str, bad: Column, detail: Column, place: dict[str, Column | str] | None = None) -> DataFrame:
    at = {c: F.lit(None).cast("int") for c in ("si", "x", "y")} | (place or {})
    return df.where(bad).select("map_id", F.lit(rule).alias("rule"), *(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in at.items()), detail.alias("detail"))


def header_violations(header: DataFrame) -> DataFrame:
    """R03 box order and R04 zoom order."""
    bad_box = (F.col("min_lat") > F.col("max_lat")) | (F.col("min_lon") > F.col("max_lon"))
    box = _violations(header, "R03", bad_box, F.concat_ws(",", "min_lat", "min_lon", "max_lat", "max_lon"))
    z = header.select("map_id", F.inline("zoom_intervals"))
    bad_zoom = (F.col("min") > F.col("base")) | (F.col("base") > F.col("max"))
    return box.unionByName(_violations(z, "R04", bad_zoom, F.concat_ws(",", "base", "min", "max"), {"si": "si"}))


def offset_violations(tiles: DataFrame) -> DataFrame:
    """R10 offset before the data, R11 past the end, R12 falling offsets. Needs data_start and size."""
    before = F.lag("offset").over(Window.partitionBy("map_id", "si").orderBy("y", "x"))
    t = tiles.withColumn("__before", before)
    place = {"si": "si", "x": F.col("x").cast("int"), "y": F.col("y").cast("int")}
    return (
        _violations(t, "R10", F.col("offset") < F.col("data_start"), F.col("offset").cast("string"), place)
        .unionByName(_violations(t, "R11", F.col("offset") > F.col("size"), F.col("offset").cast("string"), place))
        .unionByName(_violations(t, "R12", F.col("__before") > F.col("offset"), F.concat_ws(">", "__before", "offset"), place))
    )


def feature_violations(raw: DataFrame) -> DataFrame:
    """R17 / R18 layer outside -5..5, R19 / R20 tag ids outside the dictionary (columns tag_ids, n_tags)."""
    place = {"si": "si", "x": "x", "y": "y"}
    bad_layer = ~F.col("layer").between(-5, 5)
    bad_tags = F.filter("tag_ids", lambda t: t.isNotNull() & ((t < 0) | (t >= F.coalesce(F.col("n_tags"), F.lit(0)))))
    out = []
    for kind, layer_rule, tag_rule in (("poi", "R17", "R19"), ("way", "R18", "R20")):
        mine = raw.where(F.col("kind") == kind)
        out.append(_violations(mine, layer_rule, bad_layer, F.col("layer").cast("string"), place))
        tags = mine.select("map_id", "si", "x", "y", F.explode(bad_tags).alias("t"))
        out.append(_violations(tags, tag_rule, F.lit(True), F.col("t").cast("string"), place))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
