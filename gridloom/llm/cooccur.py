"""Items that appear together: pair counts by large-basket blocking.

Ordinary baskets yield their pairs in the task that holds them, many baskets of equal size at once
in numpy. A huge basket would make one task do quadratic work. Equal huge baskets are first grouped
into one with its number; each is then cut into item chunks, the chunks are dealt out to tasks, only
there repeated for the pairs they belong to, and every pair of chunks becomes a product of its own,
dealt out again. Both streams are combined per task, then per pair, and association scores follow
from the pair, item and basket counts.

Both branches are always planned and read one exchange: the pass over the baskets forms the ordinary
pairs and hands the huge baskets on, whatever their share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Baskets with more items than this are cut into chunks of CHUNK items.
ORDINARY, CHUNK = 64, 256
#: Pairs a task holds before it combines and ships them.
ROUND = 1 << 20

_PAIR = "kind string, a bigint, b bigint, n bigint"
_NAMES = ["kind", "a", "b", "n"]
_BASKET = pa.list_(pa.int64())


def _combine(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) with the sum of n."""
    coded = pa.array(np.concatenate([a, b])).dictionary_encode()
    names, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
    code = codes[: a.size] * names.size + codes[a.size :]
    order = np.argsort(code)
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return names[code[starts] // names.size], names[code[starts] % names.size], np.add.reduceat(n[order], starts)


class PairSums:
    """The pairs of a task per kind, combined and shipped whenever ROUND of them are held."""

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[np.ndarray, ...]]] = {}
        self.size: dict[str, int] = {}

    def add(self, kind: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        self.held.setdefault(kind, []).append((a, b, n))
        self.size[kind] = self.size.get(kind, 0) + a.size
        if self.size[kind] >= ROUND:
            yield from self.ship(kind)

    def ship(self, kind: str) -> Iterator[tuple]:
        self.size[kind] = 0
        yield kind, *_combine(*(np.concatenate(x) for x in zip(*self.held.pop(kind))))

    def rest(self) -> Iterator[tuple]:
        for kind in list(self.held):
            yield from self.ship(kind)


def _split(ordinary: int):
    """kind, ids (distinct, ascending, no nulls) -> counts, and huge baskets as they are.

    Counts: a < b a pair, (a, a) an item, (0, -1) the baskets of the kind, huge ones included.
    """

    def counts(kind: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * a.size, pa.string()), pa.array(a), pa.array(b), pa.array(n), pa.nulls(a.size, _BASKET)], names=[*_NAMES, "basket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums()
        baskets: dict[str, int] = {}
        for rb in batches:
            kinds = rb.column(0).dictionary_encode()
            codes = kinds.indices.to_numpy(zero_copy_only=False)
            ids = rb.column(1)
            length = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            start = np.r_[0, np.cumsum(length)[:-1]] if length.size else length
            huge = np.flatnonzero(length > ordinary)
            if huge.size:
                zero, one = (pa.array(np.full(huge.size, v, np.int64)) for v in (0, 1))
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(huge)), zero, zero, one, ids.take(pa.array(huge)).cast(_BASKET)], names=[*_NAMES, "basket"])
            for code, kind in enumerate(kinds.dictionary.to_pylist()):
                mine = codes == code
                baskets[kind] = baskets.get(kind, 0) + int(mine.sum())
                for k in np.unique(length[mine & (length > 0) & (length <= ordinary)]):
                    rows = start[mine & (length == k)]
                    i, j = np.triu_indices(k)  # the diagonal counts the items
                    step = max(1, ROUND // i.size)
                    for lo in range(0, rows.size, step):
                        items = flat[rows[lo : lo + step, None] + np.arange(k)]
                        a = items[:, i].ravel()
                        for c in sums.add(kind, a, items[:, j].ravel(), np.ones(a.size, np.int64)):
                            yield counts(*c)
        for c in sums.rest():
            yield counts(*c)
        for kind, n in baskets.items():
            yield counts(kind, *(np.array([v], np.int64) for v in (0, -1, n)))

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, n, left, right chunk: every pair of the product n times; of a chunk with itself the upper triangle."""
    sums = PairSums()

    def counts(kind: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * a.size, pa.string()), pa.array(a), pa.array(b), pa.array(n)], names=_NAMES)

    for rb in batches:
        for kind, n, x, y in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2), rb.column(3)):
            left, right = x.values.to_numpy(), y.values.to_numpy()
            if left[0] == right[0]:
                i, j = np.triu_indices(left.size)
                a, b = left[i], left[j]
            else:
                a, b = np.repeat(left, right.size), np.tile(right, left.size)
            for c in sums.add(kind, a, b, np.full(a.size, n)):
                yield counts(*c)
    for c in sums.rest():
        yield counts(*c)


def _chunk_pairs(huge: DataFrame, chunk: int) -> DataFrame:
    """kind, n, left, right: all pairs of chunks of baskets (kind, basket, n), spread evenly.

    A chunk is first dealt out by basket and place and repeated only there, so no task holds more of a
    basket than its share, and again by the pair. The numbers of partitions are given, as the work of
    a pair is far more than its bytes tell.
    """
    tasks = int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("basket"), F.lit(chunk)), lambda s: F.slice("basket", s, F.lit(chunk)))
    named = huge.select("kind", "n", F.sha2(F.array_join("basket", ",").cast("binary"), 256).alias("name"), pieces.alias("pieces"))
    dealt = named.select("kind", "n", "name", F.size("pieces").alias("m"), F.posexplode("pieces").alias("i", "x")).repartition(tasks, "kind", "name", "i")
    each = dealt.select("kind", "n", "name", "i", "x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    sides = each.select(
        "kind", "n", "name", F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"),
        F.when(F.col("i") <= F.col("o"), F.col("x")).alias("left"), F.when(F.col("i") >= F.col("o"), F.col("x")).alias("right"),
    ).repartition(tasks, "kind", "name", "lo", "hi")
    pairs = sides.groupBy("kind", "name", "lo", "hi").agg(F.max("n").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    return pairs.select("kind", "n", "left", "right")


def pair_counts(baskets: DataFrame, ordinary: int = ORDINARY, chunk: int = CHUNK) -> DataFrame:
    """kind, a, b, n, what over all baskets (kind string, ids array<bigint>, one row per basket).

    a < b (what 2): baskets that hold both; a = b (what 1): baskets that hold the item; a 0, b -1
    (what 0): baskets of the kind, empty ones included. A null kind is the kind ''. An item counts once per basket; null arrays are empty baskets and null items
    no items; equal baskets each count; an empty input gives no rows; other columns are ignored.
    No pair is left out, whatever the size of a basket.
    """
    items = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("ids", F.array().cast("array<bigint>")))))
    clean = baskets.select(F.coalesce("kind", F.lit("")).alias("kind"), items.alias("ids"))
    # ``what`` as an aggregate keeps every filter of the readers above the shuffle, so that all share it
    what = F.when(F.col("a") > F.col("b"), 0).when(F.col("a") == F.col("b"), 1).otherwise(2)
    made = clean.mapInArrow(_split(ordinary), _PAIR + ", basket array<bigint>")
    keys = [F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(-1)).alias("b")]
    held = F.coalesce("basket", F.array().cast("array<bigint>")).alias("basket")
    once = made.select(*keys, held, "n").groupBy("kind", "a", "b", "basket").agg(F.sum("n").alias("n"), F.max(F.when(F.size("basket") > 0, 3).otherwise(what)).alias("what"))
    huge = once.where("what = 3").select("kind", "basket", "n")
    products = _chunk_pairs(huge, chunk).mapInArrow(_products, _PAIR)
    counts = once.where("what < 3").select("kind", "a", "b", "n").unionByName(products)
    return counts.select(*keys, "n").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.max(what).alias("what"))


def associations(counts: DataFrame, least: int = 1, per_mille: int = 0) -> DataFrame:
    """kind, a, b, n_ab, n_a, n_b, n and lift for pairs with n_ab >= least and 1000 n_ab >= per_mille n.

    lift = n_ab n / (n_a n_b): how much more often than chance the two appear together.
    """
    pairs = counts.where((F.col("what") == 2) & (F.col("n") >= least)).select("kind", "a", "b", F.col("n").alias("n_ab"))
    totals = counts.where("what = 0").select(F.col("kind").alias("__k"), F.col("n").alias("__n"))  # a row per kind
    pairs = pairs.join(totals, F.col("kind") == F.col("__k")).where(1000 * F.col("n_ab") >= per_mille * F.col("__n"))
    single = counts.where("what = 1")
    for side in "ab":
        one = single.select(F.col("kind").alias("__k2"), F.col("a").alias("__i"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(one, (F.col("kind") == F.col("__k2")) & (F.col(side) == F.col("__i"))).drop("__k2", "__i")
    lift = F.col("n_ab").cast("double") * F.col("__n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.select("kind", "a", "b", "n_ab", "n_a", "n_b", F.col("__n").alias("n"), lift.alias("lift"))
