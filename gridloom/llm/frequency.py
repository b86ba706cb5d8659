"""Frequency of every distinct term: last-seen counters.

Records are hash-partitioned by their key and read in order. Per term a counter stores occurrences,
records and the last record in which it was seen; a record counts when it differs from that last
one, so no set of records or terms per record is ever built. Counters of one partition are combined
before the shuffle; as a record lies in one partition, partial counts of a term simply add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial counters a task holds before it combines them, and combined ones before it ships them.
PENDING, HELD = 1 << 20, 1 << 19


class LastSeenCounters:
    """Counters over a stream of (record, term) sorted by record; terms are int64 ids."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def feed(self, records: np.ndarray, terms: np.ndarray) -> None:
        """Records must not decrease, within a call and from call to call."""
        if not terms.size:
            return
        order = np.argsort(terms, kind="stable")  # per term in record order
        t, r = terms[order], records[order]
        first = np.r_[True, t[1:] != t[:-1]]
        seen_anew = first | np.r_[True, r[1:] != r[:-1]]
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], t.size] - 1
        occurrences = np.diff(np.r_[starts, t.size])
        n_records = np.add.reduceat(seen_anew.astype(np.int64), starts)
        self.parts.append((t[starts], occurrences, n_records, r[starts], r[ends]))
        self.pending += starts.size
        if self.pending > PENDING:
            self.combine()

    def combine(self) -> tuple[np.ndarray, ...]:
        """One counter per term: id, occurrences, records, first and last record."""
        if len(self.parts) > 1:
            t, o, n, lo, hi = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(t, kind="stable")
            t, o, n, lo, hi = (x[order] for x in (t, o, n, lo, hi))
            first = np.r_[True, t[1:] != t[:-1]]
            again = ~first & np.r_[False, lo[1:] == hi[:-1]]  # the record in which the term was last seen goes on
            starts = np.flatnonzero(first)
            ends = np.r_[starts[1:], t.size] - 1
            self.parts = [(t[starts], np.add.reduceat(o, starts), np.add.reduceat(n - again, starts), lo[starts], hi[ends])]
        elif not self.parts:
            self.parts = [tuple(np.empty(0, np.int64) for _ in range(5))]
        self.pending = self.parts[0][0].size
        return self.parts[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, ids -> kind, id, n_occ, n_rec, n_all; n_all, the number of records of the kind, is on id 0."""
    counters: dict[str, LastSeenCounters] = {}
    records: dict[str, int] = {}
    columns = ["kind", "id", "n_occ", "n_rec", "n_all"]
    at = 0

    def ship(kind: str) -> pa.RecordBatch:
        t, o, n, _, _ = counters.pop(kind).combine()
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * t.size, pa.string()), pa.array(t), pa.array(o), pa.array(n), pa.array(np.zeros(t.size, np.int64))], names=columns
        )

    for b in batches:
        kinds = b.column(0).dictionary_encode(null_encoding="encode")
        codes = kinds.indices.to_numpy(zero_copy_only=False)
        ids = b.column(1)
        lengths = np.nan_to_num(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = ids.flatten()
        record = np.repeat(np.arange(at, at + b.num_rows), lengths)
        owner = np.repeat(codes, lengths)
        good = flat.is_valid().to_numpy(zero_copy_only=False)
        terms = pa.compute.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        for code, kind in enumerate(kinds.dictionary.to_pylist()):
            mine = good & (owner == code)
            records[kind] = records.get(kind, 0) + int((codes == code).sum())
            c = counters.setdefault(kind, LastSeenCounters())
            c.feed(record[mine], terms[mine])
            if c.pending > HELD and c.combine()[0].size > HELD:
                yield ship(kind)
        at += b.num_rows
    for kind in list(counters):
        yield ship(kind)
    if records:
        none = pa.array([0] * len(records), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(records), pa.string()), none, none, none, pa.array(list(records.values()))], names=columns)


def term_frequencies(features: DataFrame) -> DataFrame:
    """kind, id, n_occ, n_rec, n_all over all records (kind string, ids array<bigint>, one row per record).

    n_all is 0 but on the row of id 0, where it holds the number of records of the kind, those without
    terms included. A null array or null ids count for nothing; a term repeated in a record counts
    once in n_rec and each time in n_occ; equal records each count; a null kind is the kind ''; an
    empty input gives no rows. Columns besides kind and ids are ignored.
    """
    partial = features.select("kind", "ids").mapInArrow(_count, "kind string, id bigint, n_occ bigint, n_rec bigint, n_all bigint")
    keys = [F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("id", F.lit(0)).alias("id")]
    sums = ("n_occ", "n_rec", "n_all")
    return partial.select(*keys, *sums).groupBy("kind", "id").agg(*(F.sum(c).alias(c) for c in sums))


def dictionary_frequencies(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """kind, term, n_occ, n_rec and n (records of the kind) for every term listed, unused ones with 0."""
    # both readers name all sums and filter on sums only, so they share one shuffle and one pass
    totals = counts.where("n_all > 0 and n_occ >= 0 and n_rec >= 0").select(F.col("kind").alias("__k"), F.col("n_all").alias("__n"))  # a row per kind
    used = counts.where("n_occ > 0 and n_all >= 0").select(F.col("kind").alias("__kind"), F.col("id").alias("__id"), "n_occ", "n_rec")
    return (
        terms.join(used, (F.col("kind") == F.col("__kind")) & (F.col("id") == F.col("__id")), "left")
        .join(totals, F.col("kind") == F.col("__k"), "left")
        .select("kind", "term", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(a) for c, a in (("n_occ", "n_occ"), ("n_rec", "n_rec"), ("__n", "n"))))
    )


def usefulness_mark(n_rec: str = "n_rec", n: str = "n", least: int = 5, most: int = 4):
    """``rare`` below ``least`` records, else ``common`` in more than one record in ``most``, else null."""
    return F.when(F.col(n_rec) < least, "rare").when(most * F.col(n_rec) > F.col(n), "common")
