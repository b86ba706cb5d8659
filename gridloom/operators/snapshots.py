"""What changed between consecutive full snapshots.

Every delivered row takes part twice: as the later side of the step that leads to its snapshot and
as the earlier side of the step that leaves it. ``EXCEPT ALL`` in both directions removes the rows
that are identical on both sides; both directions share one aggregation (earlier rows count -1,
later rows +1, what sums to zero goes). The residues are then full-joined by key, which labels each
key as added, removed or changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_steps(df: DataFrame, entity: Sequence[str | Column], snap: str) -> DataFrame:
    """For each entity, every snapshot number present with the next smaller and next greater one."""
    w = Window.partitionBy(*entity).orderBy(snap)
    present = df.where(F.col(snap).isNotNull()).select(*entity, snap).distinct()
    return present.select(*entity, snap, F.lag(snap).over(w).alias("__prev"), F.lead(snap).over(w).alias("__next"))


def snapshot_residues(df: DataFrame, entity: Sequence[str], snap: str, columns: Sequence[str]) -> DataFrame:
    """Rows left of each step after EXCEPT ALL both ways: ``__n`` < 0 earlier only, > 0 later only.

    Result: entity, ``from_snap``, ``to_snap``, ``columns`` and ``__n``. A row whose snapshot number is
    null belongs to no delivery and is left out; null entities are entities like any other.
    """
    steps = snapshot_steps(df, entity, snap)
    joined = df.alias("d").join(
        steps.select(*(F.col(e).alias(f"__e{i}") for i, e in enumerate(entity)), F.col(snap).alias("__snap"), "__prev", "__next"),
        [F.col(f"d.{e}").eqNullSafe(F.col(f"__e{i}")) for i, e in enumerate(entity)] + [F.col(f"d.{snap}") == F.col("__snap")],
    )
    sides = F.array(
        F.struct(F.col("__prev").alias("f"), F.col("__snap").alias("t"), F.lit(1).alias("s")),
        F.struct(F.col("__snap").alias("f"), F.col("__next").alias("t"), F.lit(-1).alias("s")),
    )
    sided = (
        joined.withColumn("__side", F.explode(sides))
        .where("__side.f is not null and __side.t is not null")
        .select(*entity, F.col("__side.f").alias("from_snap"), F.col("__side.t").alias("to_snap"), *columns, F.col("__side.s").alias("__s"))
    )
    net = sided.groupBy(*entity, "from_snap", "to_snap", *columns).agg(F.sum("__s").alias("__n"))
    return net.where("__n <> 0")


def label_changes(residues: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full join of both residues by key; ``change`` is added, removed or changed."""
    old = residues.where("__n < 0").select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__has_old"))
    new = residues.where("__n > 0").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(value).alias("__new"), F.lit(True).alias("__has_new"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    change = (
        F.when(F.col("__has_old") & F.col("__has_new"), "changed").when(F.col("__has_old"), "removed").otherwise("added")
    )
    return old.join(new, on, "full").select(
        *(F.when(F.col("__has_old"), F.col(k)).otherwise(F.col(f"__k{i}")).alias(k) for i, k in enumerate(keys)),
        change.alias("change"),
        F.col("__old").alias("old_value"),
        F.col("__new").alias("new_value"),
    )
