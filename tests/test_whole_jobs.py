"""Queries whose SQL twin covers a part of the rows only: the whole job against SQL or code of its own."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from parity import bag, views  # noqa: E402

from gridloom.operators import features, tiles  # noqa: E402
from gridloom.plans import map_queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


def same_rows(spark, name, needs, sql):
    df, res = Q.QUERIES[name](spark, SF), views(SF).execute(Q._with(needs) + sql)
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    want = bag(res.fetchall(), columns)
    assert want and bag([tuple(r) for r in df.collect()], df.columns) == want


def test_tiles_are_covered_by_the_grids_of_all_maps(spark):
    same_rows(spark, "tiles_covered_by_inputs", "t gr", "select distinct t.si, t.x, t.y from t join gr on gr.si = t.si and t.x between gr.x0 and gr.x1 and t.y between gr.y0 and gr.y1")


def test_all_intervals_are_filled(spark):
    grid = "select map_id, si, x, unnest(generate_series(y0, y1)) y from (select *, unnest(generate_series(x0, x1)) x from gr)"
    water = "select map_id, si, x, y, bool_and(is_water) is_water from t group by all"
    same_rows(spark, "grid_left_fill", "gr t", f"select g.*, coalesce(w.is_water, false) is_water, w.map_id is not null has_tile from ({grid}) g left join ({water}) w using (map_id, si, x, y)")


def test_covered_by_merges_ranges(spark):
    boxes = [(0, 1, 1, 3, 2), (0, 2, 2, 2, 5), (0, 2, 8, 2, 9), (0, 2, 9, 2, 9), (0, 2, 7, 2, 7), (1, 4, 4, 4, 4), (0, 6, 1, 5, 9), (0, None, 1, 2, 2)]
    grid = spark.createDataFrame(boxes, "si int, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    all_tiles = [(si, x, y) for si in range(2) for x in range(8) for y in range(11)]
    inside = {(si, x, y) for si, x, y in all_tiles for s, x0, y0, x1, y1 in boxes if x0 is not None and s == si and x0 <= x <= x1 and y0 <= y <= y1}
    got = [tuple(r) for r in tiles.covered_by(spark.createDataFrame(all_tiles, "si int, x int, y int"), grid).collect()]
    assert len(got) == len(set(got)) and set(got) == inside


def decoded(nodes, double):
    out, step = [], (0, 0)
    for i, (a, b) in enumerate(nodes):
        step = (step[0] + a, step[1] + b) if double and i > 1 else (a, b)
        out.append((out[-1][0] + step[0], out[-1][1] + step[1]) if out else step)
    return out


def test_absolute_nodes_of_both_encodings(spark):
    ways = {1: (True, [(5, -3), (10, 4), (2, 0), (-7, 1), (0, 0)]), 2: (False, [(5, -3), (10, 4), (2, 0)]), 3: (None, [(1, 1), (1, 1)]), 4: (True, [(9, 9)]), 5: (True, [(9, 9), (2**31 - 1, -(2**31)), (2**31 - 1, -1)])}
    rows = [(k, d, i, *n) for k, (d, ns) in ways.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "ord int, double_delta boolean, i int, dlat int, dlon int")
    got = {(r.ord, r.i): (r.lat, r.lon) for r in features.absolute_nodes(df).collect()}
    assert got == {(k, i): p for k, (d, ns) in ways.items() for i, p in enumerate(decoded(ns, d))}
    assert got[1, 4] == (5 + 10 + 12 + 5 + 5, -3 + 4 + 4 + 5 + 5)


def test_absolute_nodes_of_all_ways(spark):
    place = ["map_id", "si", "x", "y", "zi", "ord"]
    want = {}
    for w in Q._ways(spark, SF).collect():
        for b, segments in enumerate(w.blocks or []):
            for s, nodes in enumerate(segments or []):
                for i, p in enumerate(decoded([tuple(n) for n in nodes or []], w.double_delta)):
                    want[(*(w[c] for c in place), b, s, i)] = p
    rows = Q.QUERIES["way_absolute_nodes"](spark, SF).collect()
    got = {tuple(r[c] for c in (*place, "b", "s", "i")): (r.lat, r.lon) for r in rows}
    assert want and len(rows) == len(got) and got == want
