"""Term frequencies and pair counts: brute force and awkward inputs."""

import random
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))
from parity import bag, views  # noqa: E402

from gridloom.llm import frequency, map_tags  # noqa: E402
from gridloom.llm.cooccur import associations, pair_counts  # noqa: E402
from gridloom.llm.frequency import LastSeenCounters, term_frequencies  # noqa: E402

DDL = "kind string, ids array<bigint>, id bigint, n_rec string"
SF = "/root/testdata/sf0.001"


def baskets(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        size = rng.choice((0, 1, 2, 5, 9))
        ids = [rng.choice([7] * 5 + list(range(30)) + [None]) for _ in range(size)]
        rows.append((rng.choice(("poi", "way")), None if rng.random() < 0.05 else ids, 1, "x"))
    return rows


def test_term_frequencies(spark):
    rows = baskets() + [("poi", [5] * 4000 + list(range(10_000, 14_000)), 1, "x")] + [("way", [3, 3], 1, "x")] * 50
    occ, rec, n = Counter(), Counter(), Counter()
    for kind, ids, *_ in rows:
        n[kind] += 1
        occ.update((kind, i) for i in ids or () if i is not None)
        rec.update((kind, i) for i in set(ids or ()) if i is not None)
    rows = rows + [("poi", [0, 0], 1, "x")]  # id 0 is an id like any other
    occ["poi", 0] += 2
    rec["poi", 0] += 1
    n["poi"] += 1
    found = term_frequencies(spark.createDataFrame(rows, DDL).repartition(3)).collect()
    assert {(r.kind, r.id): (r.n_occ, r.n_rec) for r in found if r.n_occ} == {k: (occ[k], rec[k]) for k in occ}
    assert {r.kind: r.n_all for r in found if r.n_all} == n
    assert term_frequencies(spark.createDataFrame([], DDL)).count() == 0


def test_counters_across_feeds(monkeypatch):
    monkeypatch.setattr(frequency, "PENDING", 20)
    rng = random.Random(4)
    stream = sorted((rng.randint(0, 40), rng.randint(0, 12)) for _ in range(500))
    c = LastSeenCounters()
    for i in range(0, 500, 7):  # records go on from one feed to the next
        part = stream[i : i + 7]
        c.feed(np.array([r for r, _ in part]), np.array([t for _, t in part]))
    t, o, n, _, _ = c.combine()
    assert dict(zip(t.tolist(), zip(o.tolist(), n.tolist()))) == {x: (sum(y == x for _, y in stream), len({r for r, y in stream if y == x})) for x in {y for _, y in stream}}
    assert LastSeenCounters().combine()[0].size == 0


@pytest.mark.parametrize("ordinary, chunk", [(64, 256), (3, 2), (1, 1)])
def test_pair_counts(spark, ordinary, chunk):
    rows = baskets(2) + [("poi", list(range(100, 140)), 1, "x")]
    want = Counter()
    for kind, ids, *_ in rows:
        items = sorted({i for i in ids or () if i is not None})
        want.update([(kind, None, None)] + [(kind, i, i) for i in items] + [(kind, a, b) for a, b in combinations(items, 2)])
    got = {(r.kind, r.a if r.what else None, r.b if r.what else None): r.n for r in pair_counts(spark.createDataFrame(rows, DDL).repartition(3), ordinary, chunk).collect()}
    assert got == want
    assert pair_counts(spark.createDataFrame([], DDL)).count() == 0


def test_huge_and_equal_baskets(spark):
    """One basket of 10,001 items, forty equal ones of 700 and ordinary ones that share their items."""
    giant, big, small = list(range(10_001)), list(range(0, 7_000, 10)), [3, 10, 20]
    rows = [("poi", giant)] + [("poi", big[::-1])] * 40 + [("poi", small)] * 7 + [("way", big + [None, 0])]
    counts = pair_counts(spark.createDataFrame(rows, "kind string, ids array<bigint>").repartition(5))
    picked = [(10, 20), (3, 10), (3, 4), (10, 10), (20, 20), (9_999, 10_000)]
    one = [F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("n"))).alias(f"p{i}") for i, (a, b) in enumerate(picked)]
    got = {(r.kind, r.what): r for r in counts.groupBy("kind", "what").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *one).collect()}
    n_giant, n_big = 10_001 * 10_000 // 2, 700 * 699 // 2
    assert {k: (r.c, r.n) for k, r in got.items()} == {
        ("poi", 0): (1, 48), ("poi", 1): (10_001, 10_001 + 40 * 700 + 7 * 3), ("poi", 2): (n_giant, n_giant + 40 * n_big + 7 * 3),
        ("way", 0): (1, 1), ("way", 1): (700, 700), ("way", 2): (n_big, n_big),
    }
    r, d = got["poi", 2], got["poi", 1]
    assert (r.p0, r.p1, r.p2, r.p5, d.p3, d.p4) == (48, 8, 1, 1, 48, 48)


def test_both_branches_share_one_pass(spark):
    """Whatever the baskets, the products of chunks are planned, and the baskets are read once."""
    for size in (2, 70):
        counts = pair_counts(spark.createDataFrame([("poi", list(range(size)))], "kind string, ids array<bigint>"))
        assert counts.count() == 1 + size * (size + 1) // 2
        counts.collect()
        final, initial = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
        assert "_products" in initial and final.count("MapInArrow run") == 1
        assert size < 65 or "ReusedExchange" in final


def test_associations(spark):
    rows = [("poi", [1, 2])] * 6 + [("poi", [1])] * 4 + [("poi", None)] * 10 + [("poi", [2, 3])] * 2
    counts = pair_counts(spark.createDataFrame(rows, "kind string, ids array<bigint>"))
    (r,) = associations(counts, least=3).collect()
    assert (r.a, r.b, r.n_ab, r.n_a, r.n_b, r.n) == (1, 2, 6, 10, 8, 22) and r.lift == pytest.approx(6 * 22 / 80)


@pytest.mark.parametrize("name", map_tags.QUERIES)
def test_same_rows_as_sql(spark, name):
    df = map_tags.QUERIES[name](spark, SF)
    res = views(SF).execute(map_tags.ORACLES[name])
    columns = [d[0] for d in res.description]
    rows = [tuple(r) for r in df.collect()]
    assert rows and bag(rows, df.columns) == bag(res.fetchall(), columns)


def test_tags_of_dirty_maps(spark, tmp_path):
    """No current rows, no header, null dictionaries, clashing columns."""
    import shutil

    for t in ("poi", "way", "map_header"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.limit(0) if t == "way" else df.limit(3)).selectExpr("*", "1 as kind", "2 as ids", "3 as terms").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert map_tags.p1_frequencies(spark, str(tmp_path)).count() > 0
    assert map_tags.p4_pairs(spark, str(tmp_path)).count() >= 0
    shutil.rmtree(tmp_path / "map_header.parquet")
    spark.read.parquet(f"{SF}/map_header.parquet").limit(0).write.parquet(str(tmp_path / "map_header.parquet"))
    assert map_tags.p1_found(spark, str(tmp_path)).count() == 0
    assert map_tags.p4_found(spark, str(tmp_path)).count() == 0
