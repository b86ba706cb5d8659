"""Per-key results when a handful of keys hold most rows: dense accumulator arrays.

Rows stay in the equal splits they come in; nothing is ever shuffled by the skewed key. Each task
dictionary-encodes the keys of its split, scatter-reduces the measures into dense numpy arrays
(``bincount`` over the codes) and ships the arrays in blocks, one slot per key. The slots are then
summed by a distributed reduction (a partial sum per task, then one by key): a key present in every
split costs one slot per task, never one row per input row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots per shipped array block.
BLOCK = 1 << 14
#: Keys a task holds at once before it ships its arrays and starts over.
TASK_KEYS = 1 << 19


def _scatter(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of int64 values by code. bincount adds float64, so it serves only sums below 2**53."""
    if values.size == 0 or np.abs(values).max() < (1 << 53) // values.size:
        return np.bincount(codes, weights=values, minlength=size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, codes, values)
    return out


class DenseAccumulator:
    """A dictionary from key to slot, and dense arrays: the row count and one sum per measure."""

    def __init__(self, measures: int):
        self.measures = measures
        self.slots: dict = {}
        self.sums = np.zeros((measures + 1, 256), np.int64)

    def add(self, keys: pa.Array, values: Sequence[np.ndarray]) -> None:
        enc = keys.dictionary_encode(null_encoding="encode")
        codes = enc.indices.to_numpy(zero_copy_only=False)
        names = enc.dictionary.to_pylist()
        at = np.fromiter((self.slots.setdefault(k, len(self.slots)) for k in names), np.int64, len(names))
        if len(self.slots) > self.sums.shape[1]:
            wider = np.zeros((self.measures + 1, 2 * len(self.slots)), np.int64)
            wider[:, : self.sums.shape[1]] = self.sums
            self.sums = wider
        self.sums[0, at] += np.bincount(codes, minlength=len(names))
        for i, v in enumerate(values, 1):
            self.sums[i, at] += _scatter(codes, v, len(names))

    def blocks(self) -> Iterator[tuple[list, np.ndarray]]:
        names = list(self.slots)
        for lo in range(0, len(names), BLOCK):
            yield names[lo : lo + BLOCK], self.sums[:, lo : min(lo + BLOCK, len(names))]
        self.__init__(self.measures)


def _accumulate(measures: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = DenseAccumulator(measures)
        columns = ["key", "n", *(f"m{i}" for i in range(measures))]

        def ship() -> Iterator[pa.RecordBatch]:
            for names, sums in acc.blocks():
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(pa.array, sums)], names=columns)

        for b in batches:
            if b.num_rows:
                values = [pc.fill_null(b.column(1 + i), 0).to_numpy(zero_copy_only=False) for i in range(measures)]
                acc.add(b.column(0), values)
            if len(acc.slots) > TASK_KEYS:
                yield from ship()
        yield from ship()

    return run


def dense_key_sums(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], count: str = "n") -> DataFrame:
    """The number of rows per key and the sum of each integer measure, whatever the skew.

    Result: the ``keys``, ``count`` and the names in ``measures``, all bigint. A null key is a key of
    its own; a null measure adds nothing; repeated rows each count; an empty input gives no rows.
    Other columns of ``df`` are ignored, whatever their names.
    """
    if not keys:
        raise ValueError("at least one key is needed")
    schema = T.StructType([df.schema[k] for k in keys])
    packed = F.to_json(F.struct(*(df[k].alias(f"k{i}") for i, k in enumerate(keys))))
    slim = df.select(packed.alias("key"), *(m.cast("bigint").alias(f"m{i}") for i, m in enumerate(measures.values())))
    shipped = slim.mapInArrow(
        _accumulate(len(measures)),
        "key string, n bigint" + "".join(f", m{i} bigint" for i in range(len(measures))),
    )
    summed = shipped.groupBy("key").agg(F.sum("n").alias("n"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(measures))))
    unpacked = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(schema)])
    return summed.withColumn("key", F.from_json("key", unpacked)).select(
        *(F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)),
        F.col("n").alias(count),
        *(F.col(f"m{i}").alias(m) for i, m in enumerate(measures)),
    )
