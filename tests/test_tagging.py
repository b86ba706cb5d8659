"""Dictionary maps: brute force on awkward dictionaries, and no dictionary is ever broadcast."""

import pytest

from gridloom.operators import tagging
from gridloom.plans import map_queries as Q

SF = "/root/testdata/sf0.001"
DDL = "map_id string, poi_tags array<string>, way_tags array<string>"
OLD = [("a", ["x", "y", None, "x"], None), ("b", [], ["only"]), (None, ["x"], ["x"]), ("same", ["p", "q"], ["r"])]
NEW = [("a", ["y", "x", None, "z", "x"], ["x"]), ("c", ["x"], []), (None, ["x"], ["x"]), ("same", ["p", "q"], ["r"])]


def listed(rows):
    return [(m, kind, i, t) for m, poi, way in rows for kind, tags in (("poi", poi), ("way", way)) for i, t in enumerate(tags or [])]


def last(rows, m, kind, tag):
    return max((i for n, k, i, t in listed(rows) if (n, k, t) == (m, kind, tag) and None not in (m, tag)), default=None)


def headers(spark):
    return {v: spark.createDataFrame(rows, DDL) for v, rows in (("old", OLD), ("new", NEW))}


def same(df, want):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


#: Whatever Spark takes their size for: dictionaries unfold to many times the bytes of their files.
@pytest.mark.parametrize("name", ["cross_version_tag_map", "mapping_identity", "tag_diff_encode", "tile_zoom_erased", "drop_unmapped_features", "tag_diff_decode", "tag_map_old_new"])
def test_dictionaries_are_not_broadcast(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_cross_version_map(spark):
    got = tagging.cross_version_map(tagging.dictionary_versions(headers(spark)), ["old", "new"]).select("from_ver", "to_ver", "map_id", "kind", "old_id", "tag", "new_id")
    sides = {"old": OLD, "new": NEW}
    same(got, [(a, b, m, k, i, t, last(sides[b], m, k, t)) for a in sides for b in sides for m, k, i, t in listed(sides[a])])


def test_map_facts(spark):
    got = tagging.tag_map_facts(tagging.tag_map(tagging.dictionary_versions(headers(spark)), "old", "new"))
    same(got, [("a", "poi", False, True), ("b", "way", False, True), (None, "poi", False, True), (None, "way", False, True), ("same", "poi", True, False), ("same", "way", True, False)])


def test_tag_diff(spark):
    ref = lambda m, k, t: (last(OLD, m, k, t) + 1, None) if last(OLD, m, k, t) is not None else (0, t)
    same(tagging.tag_diff(tagging.dictionary_versions(headers(spark)), "old", "new"), [(m, k, i, *ref(m, k, t)) for m, k, i, t in listed(NEW)])


def test_split_by_dictionary(spark):
    tags = [[], ["x"], ["y", "x"], ["only"], ["p", "r"]]
    rows = [(m, k, n, t) for m in ("a", "b", "c", "same", None) for k in ("poi", "way") for n, t in enumerate(tags)]
    lost = {(m, k, t) for m, k, _, t in listed(OLD) if t is not None and last(NEW, m, k, t) is None}
    got = tagging.split_by_dictionary(spark.createDataFrame(rows, "map_id string, kind string, n int, tags array<string>"), tagging.dictionary_versions(headers(spark)), "old", "new")
    same(got.select("map_id", "kind", "n", "mapped"), [(m, k, n, m is None or not any((m, k, t) in lost for t in ts)) for m, k, n, ts in rows])


def test_tag_diff_is_decoded(spark):
    h = headers(spark)
    same(tagging.tag_diff_decoded(tagging.tag_diff(tagging.dictionary_versions(h), "old", "new"), h["old"]), listed(NEW))


def test_tag_map(spark):
    got = tagging.tag_map(tagging.dictionary_versions(headers(spark)), "old", "new")
    same(got, [(m, k, i, t, last(NEW, m, k, t)) for m, k, i, t in listed(OLD)])
