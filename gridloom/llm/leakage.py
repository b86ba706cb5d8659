"""Evaluation texts in a training corpus: CGK embedding, bit-sampling LSH, exact verification.

Edit distance between word windows is mapped to Hamming distance by the random walk of Chakraborty,
Goldenberg and Koucký: at each step the walk writes the word under its pointer and advances or stays,
as a random bit of (step, word) says. Walks over two windows that differ by few edits soon run in
step again, so the written strings agree in most places. Sampling some of these places gives a hash
that near windows share with fair probability; several walks with several samples each bring the
recall to where it is wanted. Parts of items count as well as whole ones, so the windows have the
size of the least passage that can make a case, not of the whole item.

A document is read once, whole: its windows are hashed and looked up in the index of the items, and
every item that was hit is verified against the whole document by edit distance: a dynamic programme
over all passages of the item, run where the two share a few words in a row, which every passage does.
Nothing is shuffled, so copies of a text posted again and again load no single task. The items are
taken in blocks of bounded size; all blocks are searched in the one pass over the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.words import words

#: Items whose index a task holds at once, whatever the number of items.
ITEM_BLOCK = 5_000
#: Words hashed at once in a task, per block of items.
STRETCH = 1 << 17

_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


@dataclass(frozen=True)
class Search:
    """Parameters: what is a case, and the LSH that finds candidates."""

    least_words: int = 12
    least_percent: int = 40
    words_per_edit: int = 6
    passages: int = 2
    passage_words: int = 5
    window: int = 8
    walks: int = 5
    samples: int = 3  # hashes per walk
    places: int = 6  # sampled places per hash
    steps: int = 16
    seed: int = 7

    def place_sets(self) -> np.ndarray:
        """(walk, sample, place): one place from each of equal strata of the steps."""
        rng = np.random.default_rng(self.seed)
        edges = np.linspace(0, self.steps, self.places + 1).astype(int)
        return np.stack(
            [[[rng.integers(lo, hi) for lo, hi in zip(edges, edges[1:])] for _ in range(self.samples)] for _ in range(self.walks)]
        )

    def seeds(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).integers(1, 1 << 62, self.walks).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 1 << 20):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: Iterable[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return out


def window_hashes(h: np.ndarray, starts: np.ndarray, search: Search) -> Iterator[tuple[int, np.ndarray]]:
    """(table, hash of each window) for all tables; h must end with ``window`` spare words."""
    ends = starts + search.window
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    none = np.uint64(0)
    sets = search.place_sets()
    for walk, seed in enumerate(search.seeds()):
        bits = _mixed(h ^ seed)
        at = starts.copy()
        acc = [np.full(starts.size, walk * search.samples + s + 1, np.uint64) for s in range(search.samples)]
        for step in range(search.steps):
            inside = at < ends
            wanted = [s for s in range(search.samples) if step in sets[walk, s]]
            if wanted:
                word = np.where(inside, h[at], none)
                for s in wanted:
                    acc[s] = (acc[s] ^ word) * multiplier
                    acc[s] ^= acc[s] >> np.uint64(29)
            at += (((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(bool) & inside).astype(np.int64)
        for s in range(search.samples):
            yield walk * search.samples + s, acc[s]


def own_words(items: list[tuple[int, str]], shared: set[str]) -> dict[int, list[str]]:
    """Words per item without the sentences in ``shared``."""
    out = {}
    for item, text in items:
        parts = [words(s) for s in _SENTENCE.split(text or "")]
        out[item] = [w for p in parts if " ".join(p) not in shared for w in p]
    return out


def shared_sentences(texts: Iterable[str]) -> set[str]:
    """Sentences that stand in more than one of the texts."""
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update({" ".join(words(s)) for s in _SENTENCE.split(t or "")})
    return {s for s, n in seen.items() if n > 1}


@dataclass
class ItemIndex:
    """The hashes of all windows of some items, ready for lookups."""

    search: Search
    own: dict[int, list[str]]
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # hashes of all items' words
    runs: list[np.ndarray] = field(default_factory=list)  # hashes of two and of three words in a row
    item_of: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # bitmap, hashes, places in words
    first: dict[int, int] = field(default_factory=dict)  # where an item's words begin

    BITS = 20

    @classmethod
    def of(cls, own: dict[int, list[str]], search: Search) -> ItemIndex:
        hashes = WordHashes()
        own = {i: ws for i, ws in own.items() if len(ws) >= max(search.window, search.least_words)}
        index = cls(search, own)
        flat, starts, items = [], [], []
        for item, ws in own.items():
            n = len(ws) - search.window + 1
            starts.append(np.arange(len(flat), len(flat) + n))
            items.append(np.full(len(ws), item))
            index.first[item] = len(flat)
            flat += hashes(ws)
        if own:
            h = index.words = np.array(flat + [0] * search.window, np.uint64)
            index.item_of = np.concatenate(items)
            index.runs = [_runs(h, k) for k in (2, 3)]
            s = np.concatenate(starts)
            for _, hs in window_hashes(h, s, search):
                order = np.argsort(hs, kind="stable")
                bitmap = np.zeros(1 << cls.BITS, bool)
                bitmap[hs & np.uint64((1 << cls.BITS) - 1)] = True
                index.tables.append((bitmap, hs[order], s[order]))
        return index

    def hashed(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item] + len(self.own[item])]

    def runs_of(self, item: int, k: int) -> np.ndarray:
        return self.runs[k - 2][self.first[item] : self.first[item] + len(self.own[item]) - k + 1]

    def candidates(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of window pairs that share a hash, without repetitions."""
        found = []
        mask = np.uint64((1 << self.BITS) - 1)
        for table, hs in window_hashes(h, starts, self.search):
            bitmap, known, places = self.tables[table]
            maybe = np.flatnonzero(bitmap[hs & mask])
            lo = np.searchsorted(known, hs[maybe])
            n = np.searchsorted(known, hs[maybe], side="right") - lo
            at = starts[np.repeat(maybe, n)]
            place = places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(at * self.words.size + place)
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // self.words.size, self.item_of[pairs % self.words.size]


# -- verification --------------------------------------------------------------------------------


def least_run(search: Search) -> int:
    """Words in a row that every passage shares with the item, as e edits leave at most e + 1 runs."""
    least = lambda e: max(search.passage_words, e * search.words_per_edit) - e
    return max(1, min(-(-least(e) // (e + 1)) for e in range(64)))


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    out = h[: max(h.size - k + 1, 0)]
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + out.size]
    return out


def _among(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which of x stand in the sorted pool."""
    if not pool.size:
        return np.zeros(x.size, bool)
    return pool[np.minimum(np.searchsorted(pool, x), pool.size - 1)] == x


def may_be_case(item_runs: np.ndarray, text_runs: np.ndarray, k: int, search: Search, enough: int) -> bool:
    """False only where the item has too few runs of k words in common with the text.

    A passage of n words has n - k + 1 runs, and an edit takes away at most k of them.
    ``text_runs`` are sorted.
    """
    return np.count_nonzero(_among(item_runs, text_runs)) >= enough - k * enough / search.words_per_edit - (k - 1) * search.passages


def _offsets(item: np.ndarray, text: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Where in the text the item would begin by the words in a row they share, and how many say so."""
    k = least_run(search)
    known, runs = _runs(item, k), _runs(text, k)
    order = np.argsort(known, kind="stable")
    known = known[order]
    hits = np.flatnonzero(_among(runs, known))
    lo = np.searchsorted(known, runs[hits])
    n = np.searchsorted(known, runs[hits], side="right") - lo
    place = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    return np.unique(np.repeat(hits, n) - place, return_counts=True)


def _in_step(item: np.ndarray, text: np.ndarray, start: int, search: Search) -> int:
    """Words of the longest passage at this offset whose edits only replace words: no more than there are."""
    lo, hi = max(0, -start), min(item.size, text.size - start)
    same = item[lo:hi] == text[start + lo : start + hi]
    at = np.flatnonzero(same)
    if not at.size:
        return 0
    edits = np.cumsum(~same)
    length = at[None, :] - at[:, None] + 1
    good = (edits[at][None, :] - edits[at][:, None]) * search.words_per_edit <= length
    return int(np.where(good & (length >= search.passage_words), length, 0).max())


def _regions(item: np.ndarray, text: np.ndarray, starts: np.ndarray, search: Search) -> list[tuple[int, int]]:
    """Stretches of the text outside which no passage of the item can lie."""
    slack = item.size // search.words_per_edit
    out: list[list[int]] = []
    for start in starts.tolist():
        a, b = max(start - slack, 0), min(start + item.size + slack, text.size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@lru_cache(4096)
def _range_needs(n: int, search: Search) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each range of n words: its length, whether it is long enough, the words, pairs and triples it must keep."""
    length = (np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]).astype(np.int16)
    edits = np.maximum(length, 0) // search.words_per_edit
    return length, length >= search.passage_words, [length - (k - 1) - k * edits for k in (1, 2, 3)]


def _most_words(item: np.ndarray, text: np.ndarray, search: Search) -> tuple[int, int]:
    """No fewer words than the best passage, and the best passages together, can have.

    A passage of n words with e edits keeps at least n - e of its words, n - 1 - 2 e of its pairs of
    neighbours and n - 2 - 3 e of its triples; where the text has fewer of them, none can lie.
    """
    length, good, least = _range_needs(item.size, search)
    for k, need in zip((1, 2, 3), least):
        here = _among(_runs(item, k), np.sort(_runs(text, k)))
        upto = np.zeros(item.size + k, np.int16)  # runs that begin before i
        np.cumsum(here, out=upto[1 : here.size + 1])
        upto[here.size + 1 :] = upto[here.size]
        held = upto[None, np.maximum(np.arange(item.size + 1) - k + 1, 0)] - upto[: item.size + 1, None]
        good = good & (held >= need)
    length = np.where(good, length, 0)
    before = np.maximum.accumulate(length.max(axis=0))
    after = np.maximum.accumulate(length.max(axis=1)[::-1])[::-1]
    return int(before[-1]), int((before + after).max() if search.passages > 1 else before[-1])


def _reach(item: np.ndarray, text: np.ndarray, regions: list[tuple[int, int]], search: Search, enough: int) -> np.ndarray:
    """[p, i]: words of the longest passage within the first p words of the regions and the first i of the item.

    Row a of the state holds, per i, the fewest edits that turn item[a:i] into some words of the text
    up to here. A passage begins and ends with a word that agrees and has at most one edit in
    ``words_per_edit`` of its words. Ends early once one has ``enough`` words.
    """
    n = item.size
    most = n // search.words_per_edit + 1  # one edit too many: stands for all larger numbers
    a, i = np.arange(n)[:, None], np.arange(n + 1)[None, :]
    length = i - a
    slope = np.arange(n + 1, dtype=np.int16)[None, :]
    allowed = np.where(length >= search.passage_words, length // search.words_per_edit, -1)
    best = np.zeros((sum(y - x for x, y in regions) + 1, n + 1), np.int32)
    p = 0
    for x, y in regions:
        state = np.full((n, n + 1), most, np.int16)
        idle = True
        for word in text[x:y]:
            same = item == word
            p += 1
            best[p] = best[p - 1]
            if idle and not same.any():
                continue
            idle = False
            moved = np.full((n, n + 1), most, np.int16)
            moved[:, 1:] = state[:, :-1]
            ended = np.flatnonzero(same)
            starts = moved.copy()
            starts[ended, ended + 1] = 0
            arrived = starts[:, ended + 1]
            good = arrived <= allowed[:, ended + 1]
            if good.any():
                found = np.where(good, length[:, ended + 1], 0).max(axis=0)
                best[p, ended + 1] = np.maximum(best[p, ended + 1], found)
                np.maximum.accumulate(best[p], out=best[p])
                if best[p, n] >= enough:
                    best[p:] = best[p]
                    return best
            moved[:, 1:] += ~same  # another word in its place
            moved[ended, ended + 1] = 0
            np.minimum(moved, state + 1, out=moved)  # a word of the text too many
            moved -= slope  # words of the item left out: one edit each
            np.minimum.accumulate(moved, axis=1, out=moved)
            moved += slope
            state = np.minimum(moved, most)
            idle = bool((state >= most).all())
    return best


def words_in_passages(item: np.ndarray, text: np.ndarray, search: Search, enough: int | None = None) -> int:
    """Words of the item in its best one or two passages in the text, in the item's order.

    Exact in whether it reaches ``enough``; two passages overlap neither in the item nor in the text.
    """
    enough = item.size if enough is None else enough
    starts, votes = _offsets(item, text, search)
    if not starts.size:
        return 0
    if (n := _in_step(item, text, int(starts[votes.argmax()]), search)) >= enough:
        return n
    regions = _regions(item, text, starts, search)
    if (most := _most_words(item, np.concatenate([text[a:b] for a, b in regions]), search)[1]) < enough:
        return most
    # offsets whose own stretch can hold no passage that is long enough beside the best one
    each = np.array([_most_words(item, text[a:b], search)[0] for (a, b), in (_regions(item, text, starts[i : i + 1], search) for i in range(starts.size))])
    useful = each + (each.max() if search.passages > 1 else 0) >= enough
    if not useful.any():
        return 0
    regions = _regions(item, text, starts[useful], search)
    before = _reach(item, text, regions, search, enough)
    if search.passages < 2 or before[-1, -1] >= enough or not before[-1, -1]:
        return int(before[-1, -1])
    backwards = [(text.size - b, text.size - a) for a, b in reversed(regions)]
    after = _reach(item[::-1], text[::-1], backwards, search, item.size + 1)
    return int((before + after[::-1, ::-1]).max())


def needed(n: int, search: Search) -> int:
    """Words of an item of ``n`` own words that make a case."""
    return max(search.least_words, -(-search.least_percent * n // 100))


def is_case(item: list[str], text: list[str], search: Search) -> bool:
    hashes = WordHashes()
    enough = needed(len(item), search)
    return words_in_passages(np.array(hashes(item), np.uint64), np.array(hashes(text), np.uint64), search, enough) >= enough


# -- search --------------------------------------------------------------------------------------


class Blocks:
    """The item indexes, block by block; one is held at a time, a single one is kept."""

    def __init__(self, own: list[dict[int, list[str]]], search: Search):
        self.own, self.search = own, search
        self.kept = ItemIndex.of(own[0], search) if len(own) == 1 else None

    def __iter__(self) -> Iterator[ItemIndex]:
        if self.kept:
            yield self.kept
        else:
            yield from (ItemIndex.of(o, self.search) for o in self.own)


def leaked(docs: Iterable[tuple[object, str | None]], blocks: Blocks | ItemIndex, hashes: WordHashes) -> Iterator[tuple[object, int]]:
    """(document, item) of every verified case."""
    if isinstance(blocks, ItemIndex):
        blocks = Blocks([blocks.own], blocks.search)
    search, w = blocks.search, blocks.search.window
    keys: list[object] = []
    flat: list[int] = []
    first: list[int] = []

    def run() -> Iterator[tuple[object, int]]:
        h = np.array(flat + [0] * w, np.uint64)
        ends = first[1:] + [len(flat)]
        starts = np.concatenate([np.arange(a, b - w + 1) for a, b in zip(first, ends)])
        for index in blocks:
            if not index.tables:
                continue
            at, items = index.candidates(h, starts)
            doc = np.searchsorted(first, at, side="right") - 1
            last, text, runs = -1, h[:0], [h[:0]] * 2
            for d, i in zip(*(x.tolist() for x in np.divmod(np.unique(doc * (1 << 32) + items), 1 << 32))):
                item, enough = index.hashed(i), needed(len(index.own[i]), search)
                if d != last:
                    last, text = d, h[first[d] : ends[d]]
                    runs = [np.sort(_runs(text, k)) for k in (2, 3)]
                if all(may_be_case(index.runs_of(i, k), runs[k - 2], k, search, enough) for k in (2, 3)) and words_in_passages(item, text, search, enough) >= enough:
                    yield keys[d], i
        keys.clear(), flat.clear(), first.clear()

    for key, text in docs:
        ws = words(text)
        if len(ws) < search.least_words:
            continue
        first.append(len(flat))
        keys.append(key)
        flat += hashes(ws)
        if len(flat) > STRETCH * len(blocks.own):
            yield from run()
    if keys:
        yield from run()


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "item_text",
    search: Search = Search(),
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """``key`` and ``item_key`` of every document that holds a passage of an item.

    A case: at least 12 words and 40 percent of the item's own words stand in the document, in one or
    two passages in the item's order, with up to one word in six of a passage changed, left out or put
    in. Sentences that several items share are not an item's own. Null and empty texts, and items of
    under 12 own words, have no case; of items with equal keys the one with the greatest text counts;
    repeated documents give one row each time. The items are the stated query set: they are read on the
    driver and their words are sent to the tasks, which hold the index of one block of ``block`` items
    at a time. The documents are read once and not moved at all.
    """
    rows = items.select(item_key, item_text).where(items[item_key].isNotNull()).collect()
    texts = dict(sorted((r[0], r[1] or "") for r in rows))
    shared = shared_sentences(texts.values())
    names = sorted(texts)
    number = {k: i for i, k in enumerate(names)}
    own = own_words([(number[k], texts[k]) for k in names], shared)
    parts = [{i: own[i] for i in range(lo, min(lo + block, len(names)))} for lo in range(0, len(names), block)]
    sent = docs.sparkSession.sparkContext.broadcast((parts or [{}], names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own_parts, ids = sent.value
        blocks = Blocks(own_parts, search)

        def texts_of() -> Iterator[tuple[object, str | None]]:
            for b in batches:
                yield from zip(b.column(0), b.column(1).to_pylist())

        pairs = leaked(texts_of(), blocks, hashes)
        while some := list(islice(pairs, 10_000)):
            keys, found = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], keys[0].type), pa.array([ids[i] for i in found])], names=[key, item_key])

    schema = T.StructType([docs.schema[key], T.StructField(item_key, items.schema[item_key].dataType)])
    return docs.select(key, text).mapInArrow(scan, schema)
