"""Filling fixed-capacity containers: linear grouping over the histogram of lengths.

Lengths are whole tokens up to the capacity, so the histogram of all lengths has at most ``capacity``
rows however many documents there are. The whole optimisation runs on it:

1. Large items, sorted by length, are cut into groups of equal cardinality, and each group's lengths
   are rounded up to its largest one. That leaves a few sizes.
2. The cheapest mix of container configurations over these sizes is found by column generation
   (a simplex step per new configuration, a knapsack to price it) and rounded down.
3. The actual lengths take their group's slots, which shows the space really left in each container.
4. What the rounding left over and the small items follow by best fit, longest first.

The outcome is a plan of runs: items of one length with consecutive ranks go to consecutive
containers. Ranks are computed by Spark, and each item looks up its run; no item leaves its task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

#: Items longer than this share of the capacity are large.
LARGE = 1 / 8
#: Groups of equal cardinality among the large items.
GROUPS = 40
#: Items of one length that one window task ranks; longer runs are ranked in buckets.
RANK_ROWS = 200_000


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity (unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for g, (s, p) in enumerate(zip(sizes, prices)):
        if p <= 0:
            continue
        for lo in range(s, capacity + 1, s):  # each stretch builds on the one before it
            hi = min(lo + s, capacity + 1)
            gain = value[lo - s : hi - s] + p
            better = gain > value[lo:hi] + 1e-12
            value[lo:hi][better] = gain[better]
            last[lo:hi][better] = g
    counts = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0 and last[room] >= 0:
        counts[last[room]] += 1
        room -= sizes[last[room]]
    return float(prices @ counts), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 2000) -> list[tuple[int, np.ndarray]]:
    """(times, configuration) of the linear optimum, rounded down; never more slots than demand."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(columns)
    for _ in range(steps):
        prices = np.linalg.solve(columns.T, np.ones(m))
        value, new = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, new.astype(float))
        up = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(np.argmin(ratio))
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x[x < 0] = 0
        columns[:, out] = new
    left = demand.astype(np.int64).copy()
    found = []
    for times, conf in sorted(zip(np.floor(x + 1e-6).astype(np.int64), columns.T.round().astype(np.int64)), key=lambda f: -f[0]):
        used = conf > 0
        times = int(min(times, (left[used] // conf[used]).min())) if used.any() else 0
        if times:
            found.append((times, conf))
            left -= times * conf
    return found


class PackingPlan:
    """Runs (length, first rank, end rank, first container, items per container) for one capacity."""

    def __init__(self, histogram: Mapping[int, int], capacity: int, large: float = LARGE, groups: int = GROUPS):
        self.capacity, self.containers, self.runs = capacity, 0, []
        self.room: dict[int, list[tuple[int, int]]] = {}  # space left -> runs of containers [from, to)
        self.spaces: list[int] = []  # the keys of room, ascending
        self.next_rank = dict.fromkeys(histogram, 0)
        counts = {int(n): int(c) for n, c in histogram.items() if c > 0}
        self._large({n: c for n, c in counts.items() if n > large * capacity}, groups)
        for n in sorted(counts, reverse=True):
            if n:
                self._best_fit(n, counts[n] - self.next_rank[n])
        if counts.get(0):  # empty items need no space; they go to the first container
            self.containers = max(1, self.containers)
            self.runs.append((0, 0, counts[0], 0, counts[0]))

    def _add_room(self, space: int, lo: int, hi: int) -> None:
        if space and hi > lo:
            if space not in self.room:
                bisect.insort(self.spaces, space)
                self.room[space] = []
            self.room[space].append((lo, hi))

    def _large(self, counts: dict[int, int], groups: int) -> None:
        lengths = sorted(counts, reverse=True)
        total = sum(counts.values())
        if not total:
            return
        bounds = [total * g // groups for g in range(groups + 1)]
        grouped: dict[int, list[list[int]]] = {}  # rounded size -> [length, first rank, end rank] in falling order
        at, g = 0, 0
        for n in lengths:
            rank = 0
            while rank < counts[n]:
                while g < groups - 1 and at >= bounds[g + 1]:
                    g += 1
                    size = n
                if at == 0:
                    size = n
                take = min(counts[n] - rank, (bounds[g + 1] if g < groups - 1 else total) - at)
                grouped.setdefault(size, []).append([n, rank, rank + take])
                rank, at = rank + take, at + take
        sizes = np.array(list(grouped))
        demand = np.array([sum(b - a for _, a, b in pieces) for pieces in grouped.values()])
        pools = list(grouped.values())
        for times, conf in configurations(sizes, demand, self.capacity):
            base, self.containers = self.containers, self.containers + times
            cuts, used = {0, times}, []
            for pool, copies in zip(pools, conf):
                for _ in range(copies):
                    done = 0
                    while done < times:
                        n, a, b = pool[0]
                        take = min(b - a, times - done)
                        self.runs.append((n, a, a + take, base + done, 1))
                        self.next_rank[n] = max(self.next_rank[n], a + take)
                        used.append((done, done + take, n))
                        done += take
                        cuts.add(done)
                        pool[0][1] += take
                        if pool[0][1] == b:
                            pool.pop(0)
            marks = sorted(cuts)
            index = {c: i for i, c in enumerate(marks)}
            filled = np.zeros(len(marks), np.int64)
            for a, b, n in used:
                filled[index[a]] += n
                filled[index[b]] -= n
            for lo, hi, load in zip(marks, marks[1:], np.cumsum(filled)):
                self._add_room(self.capacity - int(load), base + lo, base + hi)
        self._leftovers(pools)

    def _leftovers(self, pools: list[list[list[int]]]) -> None:
        """Large items without a slot keep their own ranks; a length may be left over in two groups."""
        for n, a, b in sorted((tuple(p) for pool in pools for p in pool), reverse=True):
            self._best_fit(n, b - a, a)
            self.next_rank[n] = max(self.next_rank[n], b)

    def _best_fit(self, n: int, count: int, rank: int | None = None) -> None:
        rank = self.next_rank[n] if rank is None else rank
        while count:
            i = bisect.bisect_left(self.spaces, n)
            if i == len(self.spaces):  # no container has room: open as many as the rest needs
                opened = -(-count // (self.capacity // n))
                self._add_room(self.capacity, self.containers, self.containers + opened)
                self.containers += opened
                continue
            space = self.spaces[i]
            lo, hi = self.room[space].pop()
            if not self.room[space]:
                del self.room[space], self.spaces[i]
            each = space // n
            whole = min(hi - lo, count // each)
            if whole:
                self.runs.append((n, rank, rank + whole * each, lo, each))
                self._add_room(space - each * n, lo, lo + whole)
                rank, count = rank + whole * each, count - whole * each
            if whole < hi - lo and count:  # fewer are left than one container takes
                self.runs.append((n, rank, rank + count, lo + whole, count))
                self._add_room(space - count * n, lo + whole, lo + whole + 1)
                self._add_room(space, lo + whole + 1, hi)
                return
            self._add_room(space, lo + whole, hi)


def _place(plans: dict):
    """Adds container_no: rows kind, length, rank, ... look up their run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(0).dictionary_encode()
            codes = kinds.indices.to_numpy(zero_copy_only=False)
            length = b.column(1).to_numpy(zero_copy_only=False)
            rank = b.column(2).to_numpy(zero_copy_only=False)
            number = np.zeros(b.num_rows, np.int64)
            for code, kind in enumerate(kinds.dictionary.to_pylist()):
                n, first, container, each = plans[kind]
                mine = np.flatnonzero(codes == code)
                # runs are sorted by (length, first rank): the run is the last one not after the item
                for size in np.unique(length[mine]):
                    here = mine[length[mine] == size]
                    lo, hi = np.searchsorted(n, size), np.searchsorted(n, size, side="right")
                    at = lo + np.searchsorted(first[lo:hi], rank[here], side="right") - 1
                    number[here] = container[at] + (rank[here] - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *b.columns[3:], pa.array(number)], names=[*b.schema.names[:2], *b.schema.names[3:], "container_no"])

    return run


def pack(counts: DataFrame, capacities: Mapping[str, int], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Puts every item into one container of each kind in ``capacities``.

    Result: container_kind, container_no, ``key``, part_no, token_from, n_tokens. Only items larger
    than the capacity are divided, into full containers and a rest. A null size counts as 0; items of
    size 0 take no space and go to the first container; equal rows are items of their own; no rows
    give no containers. Other columns are ignored. The plan of each kind is bounded by its capacity,
    not by the number of items.
    """
    if any(c is None or c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in capacities.items()))
    items = counts.select(F.col(key).alias("__key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("__n"))
    items = items.select("__key", "__n", F.inline(kinds))
    last = F.greatest(F.ceil(F.col("__n") / F.col("capacity")).cast("bigint") - 1, F.lit(0))
    pieces = items.select("kind", "__key", "__n", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part_no"))
    pieces = pieces.select(
        "kind",
        F.least(F.col("capacity"), F.col("__n") - F.col("part_no") * F.col("capacity")).alias("n_tokens"),
        "__key",
        "part_no",
        (F.col("part_no") * F.col("capacity")).alias("token_from"),
    )
    # at most capacity + 1 rows per kind
    histogram: dict[str, dict[int, int]] = {k: {} for k in capacities}
    for kind, n, c in pieces.groupBy("kind", "n_tokens").count().collect():
        histogram[kind][n] = c
    plans = {}
    for kind, capacity in capacities.items():
        runs = sorted(PackingPlan(histogram[kind], capacity).runs)
        plans[kind] = tuple(np.array([r[i] for r in runs], np.int64) for i in (0, 1, 3, 4))

    # rank within a length: buckets keep a length that a third of the items share from loading one task
    buckets = 1 + max((c for h in histogram.values() for c in h.values()), default=0) // RANK_ROWS
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("__key", "part_no"), F.lit(buckets)).cast("int"))
    group = ["kind", "n_tokens", "bucket"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__key", "part_no")).cast("bigint") - 1
    ranked = pieces.withColumn("rank", rank)
    if buckets > 1:
        before = Window.partitionBy("kind", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = pieces.groupBy(*group).agg(F.count("*").alias("__c"))
        offset = sizes.select(*(F.col(g).alias(f"__{g}") for g in group), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
        ranked = ranked.join(offset, [F.col(g) == F.col(f"__{g}") for g in group]).withColumn("rank", F.col("rank") + F.col("__before"))
    ddl = counts.schema[key].dataType.simpleString()
    placed = ranked.select("kind", "n_tokens", "rank", "__key", "part_no", "token_from").mapInArrow(
        _place(plans), f"kind string, n_tokens bigint, __key {ddl}, part_no bigint, token_from bigint, container_no bigint"
    )
    return placed.select(F.col("kind").alias("container_kind"), "container_no", F.col("__key").alias(key), "part_no", "token_from", "n_tokens")


def pack_texts(docs: DataFrame, capacities: Mapping[str, int], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """:func:`pack` of whole texts by their token counts, which are computed once and kept."""
    from gridloom.llm.tokens import token_counts

    return pack(cut_lineage(token_counts(docs, key, text, **options)), capacities, key)
