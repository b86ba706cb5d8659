"""Copies, snapshots and hot keys: brute force on small tables, and the awkward inputs."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators.copies import comparable, copy_differences
from gridloom.operators.hotkeys import dense_key_sums
from gridloom.operators.snapshots import label_changes, snapshot_residues
from gridloom.session import cut_lineage, ensure_checkpoint_dir
from gridloom.tables import current_rows

T0 = datetime(2024, 1, 1)
DDL = "k string, n int, v string, w int, at timestamp, __at int, field string"


def side(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    return comparable(df, {"k": F.col("k"), "n": F.col("n")}, {"v": F.col("v"), "w": F.col("w")}, "at")


def differences(spark, base, copy):
    found = copy_differences(side(spark, base), side(spark, copy), ["k", "n"], ["v", "w"])
    assert found.columns == ["k", "n", "field"]
    return Counter(tuple(r) for r in found.collect())


def row(k, n, v, w, day=0):
    return (k, n, v, w, T0 + timedelta(days=day), 1, "x")


def test_copies_awkward_rows(spark):
    long = "z" * 300_000
    base = [row("a", 1, "x", 1), row("a", 1, "old", 9, -3), row("a", 1, "x", 1), row(None, None, "n", None), row("b", 2, None, 2), row("c", 3, "", 3), row("e", 5, long, 5), row("f", 6, "v", None)]
    copy = [row("a", 1, "x", 2), row(None, None, "n", None), row("b", 2, None, 2), row("c", 3, None, 3), row("d", 4, "v", 4), row("e", 5, long[:-1] + "y", 5)]
    want = {("a", 1, "w"), ("c", 3, "v"), ("d", 4, "missing_in_base"), ("e", 5, "v"), ("f", 6, "missing_in_copy")}
    assert differences(spark, base, copy) == Counter(want)


def test_copies_empty_sides(spark):
    rows = [row("a", 1, "x", 1), row("b", 1, "x", 1)]
    assert differences(spark, [], []) == Counter()
    assert differences(spark, rows, []) == Counter({("a", 1, "missing_in_copy"), ("b", 1, "missing_in_copy")})
    assert differences(spark, [], rows) == Counter({("a", 1, "missing_in_base"), ("b", 1, "missing_in_base")})


def test_copies_against_brute_force(spark):
    rng = random.Random(1)
    make = lambda: [row(f"k{rng.randint(0, 60)}", rng.randint(0, 3), rng.choice("ab") if rng.random() < 0.9 else None, rng.randint(0, 1), rng.randint(0, 10**6) / 1e6) for _ in range(400)]
    base, copy = make(), make()
    now = lambda rows: {(r[0], r[1]): r[2:4] for r in sorted(rows, key=lambda r: r[4])}
    a, b = now(base), now(copy)
    want = Counter([(*k, "missing_in_copy") for k in a.keys() - b.keys()] + [(*k, "missing_in_base") for k in b.keys() - a.keys()])
    want += Counter((*k, f) for k in a.keys() & b.keys() for f, x, y in zip("vw", a[k], b[k]) if x != y)
    assert differences(spark, base, copy) == want


def test_ties_do_not_depend_on_order(spark):
    rows = [row("a", 1, v, 1) for v in "bca"]
    got = {side(spark, rows[i:] + rows[:i]).first().f_v for i in range(3)}
    assert len(got) == 1


def test_current_rows_null_time_is_least(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 5, "t"), (None, None, "x"), (None, 1, "y")], "k int, at int, v string")
    assert {(r.k, r.v) for r in current_rows(df, ["k"], "at").collect()} == {(1, "t"), (None, "y")}


def test_snapshots(spark):
    rows = [("m", 1, "a", "1"), ("m", 1, "b", "1"), ("m", 1, "d", "1"), ("m", 3, "a", "1"), ("m", 3, "b", "2"), ("m", 3, "c", None), ("m", 4, "c", None), (None, 7, "q", "1"), (None, 9, "r", "1"), ("one", 5, "s", "1"), ("m", None, "zz", "1")]
    df = spark.createDataFrame(rows, "e string, snap int, k string, v string")
    residues = snapshot_residues(df, ["e"], "snap", ["k", "v"])
    got = {(r.e, r.from_snap, r.to_snap, r.k, r.change, r.old_value, r.new_value) for r in label_changes(residues, ["e", "from_snap", "to_snap", "k"], "v").collect()}
    assert got == {
        ("m", 1, 3, "b", "changed", "1", "2"), ("m", 1, 3, "c", "added", None, None), ("m", 1, 3, "d", "removed", "1", None),
        ("m", 3, 4, "a", "removed", "1", None), ("m", 3, 4, "b", "removed", "2", None), (None, 7, 9, "q", "removed", "1", None), (None, 7, 9, "r", "added", None, "1"),
    }
    assert snapshot_residues(df.limit(0), ["e"], "snap", ["k", "v"]).count() == 0


def test_snapshots_keep_multiplicity(spark):
    df = spark.createDataFrame([("m", 1, "a"), ("m", 1, "a"), ("m", 2, "a")], "e string, snap int, k string")
    assert [(r.k, r["__n"]) for r in snapshot_residues(df, ["e"], "snap", ["k"]).collect()] == [("a", -1)]


def test_dense_sums_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + [f"k{i}" for i in range(50)] + [None, ""]), rng.randint(0, 2), rng.randint(-5, 5) if rng.random() < 0.9 else None, "junk", 1) for _ in range(5000)]
    rows += [("big", 0, 2**62, "junk", 1), ("big", 0, -(2**61), "junk", 1)]
    df = spark.createDataFrame(rows, "a string, b int, v bigint, key string, m0 int").repartition(5)
    want: dict = {}
    for a, b, v, *_ in rows:
        n, s = want.get((a, b), (0, 0))
        want[a, b] = (n + 1, s + (v or 0))
    got = dense_key_sums(df, ["a", "b"], {"total": F.col("v")}, "rows")
    assert got.columns == ["a", "b", "rows", "total"]
    assert {(r.a, r.b): (r.rows, r.total) for r in got.collect()} == want
    assert dense_key_sums(df.limit(0), ["a"], {}).count() == 0
    with pytest.raises(ValueError):
        dense_key_sums(df, [], {})


def test_accumulator_ships_when_full(monkeypatch):
    import pyarrow as pa

    from gridloom.operators import hotkeys

    monkeypatch.setattr(hotkeys, "TASK_KEYS", 10)
    monkeypatch.setattr(hotkeys, "BLOCK", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array([str(i % 37) for i in range(s, s + 50)]), pa.array([1] * 50)], names=["key", "m0"]) for s in range(0, 500, 50)]
    total = Counter()
    shipped = list(hotkeys._accumulate(1)(iter(batches)))
    for b in shipped:
        total.update(dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist())))
    assert total == Counter(str(i % 37) for i in range(500)) and len(shipped) > 10


def test_checkpoints_follow_the_session(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder and cut_lineage(spark.range(3)).count() == 3
