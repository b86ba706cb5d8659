"""Text dump of features, line by line, and its inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A double-quoted string with backslash escapes."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _entry(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name} = "), value))


def tag_list(tags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tags, quoted), ", "), F.lit("]"))


def feature_lines(features: DataFrame) -> DataFrame:
    """Adds ``lines``: the dump of each feature as an array of lines. Absent values have no line."""
    s = lambda c: F.col(c).cast("string")
    q = lambda c: quoted(F.col(c))
    tags = _entry("tags", tag_list(F.coalesce("tags", F.array().cast("array<string>"))))
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    poi = [
        F.lit("[[tiles.pois]]"), _entry("zi_index", s("zi")), _entry("lat", s("lat")), _entry("lon", s("lon")), _entry("layer", s("layer")), tags,
        _entry("name", q("name")), _entry("house_number", q("house_number")), _entry("elevation", s("elevation")),
    ]
    way = [
        F.lit("[[tiles.ways]]"), _entry("zi_index", s("zi")), _entry("layer", s("layer")), _entry("sub_tile_bitmap", s("sub_tile_bitmap")), _entry("encoding", flag("encoding")), tags,
        _entry("name", q("name")), _entry("house_number", q("house_number")), _entry("reference", q("reference")),
        _entry("label_lat", s("label_lat")), _entry("label_lon", s("label_lon")), _entry("blocks", F.to_json("blocks")),
    ]
    return features.withColumn("lines", F.array_compact(F.when(F.col("kind") == "poi", F.array(*poi)).otherwise(F.array(*way))))


def parse_tag_list(line: Column) -> Column:
    """The strings of a ``tags = [...]`` line; null if it is none."""
    return F.from_json(F.regexp_extract(line, r"^tags = (\[.*\])$", 1), "array<string>")
