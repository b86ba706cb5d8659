"""Differences between two copies of the same data.

Both copies are range-partitioned on the key with the same split points, sorted within partitions
and read by one streaming pass with a pointer on each copy. Large fields travel as SHA-256 digests
of their canonical text, so the shuffles carry a few hundred bytes per row whatever the row holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.tables import current_rows

MISSING_IN_COPY, MISSING_IN_BASE = "missing_in_copy", "missing_in_base"


def digest(text: Column) -> Column:
    """SHA-256 of a text; null stays null."""
    return F.sha2(text.cast("string").cast("binary"), 256)


def comparable(df: DataFrame, keys: Mapping[str, Column], fields: Mapping[str, Column], at: str) -> DataFrame:
    """The current row of each key, reduced to the key and one string per compared field."""
    slim = df.select(
        *(c.alias(k) for k, c in keys.items()),
        *(c.cast("string").alias(f"f_{k}") for k, c in fields.items()),
        F.col(at).alias("__at"),
    )
    return current_rows(slim, list(keys), "__at", [f"f_{k}" for k in fields]).drop("__at")


def _merge(keys: Sequence[str], fields: Sequence[str]):
    """Streams rows sorted by (key, side): side 0 is the base, side 1 the copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        base: tuple | None = None  # the base row whose counterpart has not been seen yet
        nk = len(keys)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * (nk + 1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*keys, "field"])

        types: list[pa.DataType] = []
        for b in batches:
            types = [*(b.schema.field(i).type for i in range(nk)), pa.string()]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key, side = row[:nk], row[nk]
                if side == 0:
                    if base is not None:
                        out.append((*base[:nk], MISSING_IN_COPY))
                    base = row
                elif base is not None and base[:nk] == key:
                    out += [(*key, f) for f, x, y in zip(fields, base[nk + 1 :], row[nk + 1 :]) if x != y]
                    base = None
                else:
                    if base is not None:
                        out.append((*base[:nk], MISSING_IN_COPY))
                        base = None
                    out.append((*key, MISSING_IN_BASE))
            if len(out) > 10_000:
                yield flush()
        if base is not None:
            out.append((*base[:nk], MISSING_IN_COPY))
        if out:
            yield flush()

    return run


def copy_differences(base: DataFrame, copy: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows missing on either side and fields that differ, for inputs with one row per key and side.

    Result: the keys and ``field``: ``missing_in_copy``, ``missing_in_base`` or the name of a field
    whose values differ. ``f_<name>`` holds a field's text (see :func:`comparable`). Null equals only
    null, in keys and fields. Empty inputs give the rows of the other side as missing; two empty
    inputs give none.
    """
    columns = [*keys, *(f"f_{f}" for f in fields)]
    both = base.select(*columns, F.lit(0).alias("__side")).unionByName(copy.select(*columns, F.lit(1).alias("__side")))
    ranged = (
        both.select(*keys, "__side", *(f"f_{f}" for f in fields))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys, "__side")
    )
    ddl = ", ".join(f"`{k}` {base.schema[k].dataType.simpleString()}" for k in keys) + ", field string"
    return ranged.mapInArrow(_merge(list(keys), list(fields)), ddl)
