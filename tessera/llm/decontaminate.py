"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words that a document shares with a benchmark item; a
Karp-Rabin hash of each run is rolled over all documents of a batch at once.
For each document and item that share seeds, the longest matches are marked
again and again, no word twice, until none of five words is left. The share of
the item's words that are covered tells a copy, also one in another order.
Matches are grown from the pairs of equal seeds; where repeated words would make
too many such pairs, the longest match is searched for by its length instead.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.runtime import slices

SEED_WORDS = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.8
#: Characters of the benchmark held at once, in one broadcast; a larger one is searched for in several passes.
BLOCK_CHARS = 32_000_000
WORD = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15
FILTER_BITS = 20
#: Pairs of equal seeds held at once; a text and an item with more are tiled without listing them.
PAIRS = 1 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Index:
    """Seeds of the benchmark's items. Items of fewer than five words have none: they are kept whole."""

    def __init__(self, items: list[tuple[int, str | None]], pairs: int = PAIRS):
        self.pairs = pairs
        self.vocabulary: dict[str, int] = {}
        self.items = []
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, text in items:
            said = words(text)
            if len(said) >= SEED_WORDS:
                self.items.append((item, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in said], dtype=np.uint64)))
            elif said:
                self.short[tuple(said)].append(item)
        hashes = [self.roll(x) for _, x in self.items]
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.of_item = np.repeat(np.arange(len(self.items)), [len(h) for h in hashes])[order] if hashes else order
        self.of_word = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else order
        self.flat = np.concatenate([np.zeros(0, dtype=np.uint64), *(x for _, x in self.items)])
        self.base = np.cumsum([0, *(len(x) for _, x in self.items)])
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self._slot(self.seeds)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    @staticmethod
    def roll(ids: np.ndarray) -> np.ndarray:
        """A hash of each run of five ids."""
        n = max(0, len(ids) - SEED_WORDS + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(SEED_WORDS):
            h = h * np.uint64(BASE) + ids[j : j + n]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def search(self, texts: list[str | None], coverage: float = COVERAGE):
        """``(text, item, words of the item, tiles)`` of each text and item whose tiles cover that share of the item."""
        get = self.vocabulary.get
        ids, begins, at = [], [], 0
        for i, t in enumerate(texts):
            said = words(t)
            if len(said) < SEED_WORDS:
                yield from ((i, item, len(said), [(len(said), 0, 0)]) for item in self.short.get(tuple(said), ()))
            own = [get(w, 0) for w in said]
            begins.append(at)
            at += len(own) + 1
            ids += own
            ids.append(0)
        known = np.array(ids, dtype=np.uint64)
        h = self.roll(known)
        hit = np.flatnonzero(self.filter[self._slot(h)])
        left = np.searchsorted(self.seeds, h[hit], "left")
        count = np.searchsorted(self.seeds, h[hit], "right") - left
        hit, left, count = hit[count > 0], left[count > 0], count[count > 0]
        if not len(hit):
            return
        doc = np.searchsorted(begins, hit, "right") - 1
        # texts together while their pairs are few; a text with too many alone
        cut = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
        total = np.cumsum([0, *count.tolist()])
        start = 0
        for a, b in zip(cut, cut[1:], strict=False):
            if total[b] - total[start] > self.pairs:
                if start < a:
                    yield from self._matched(known, begins, hit[start:a], left[start:a], count[start:a], coverage)
                start = a
                if total[b] - total[a] > self.pairs:
                    end = begins[doc[a] + 1] if doc[a] + 1 < len(begins) else len(known)
                    yield from self._crowded(int(doc[a]), known[begins[doc[a]] : end], hit[a:b] - begins[doc[a]], left[a:b], count[a:b], coverage)
                    start = b
        if start < len(doc):
            yield from self._matched(known, begins, hit[start:], left[start:], count[start:], coverage)

    def _matched(self, known, begins, hit, left, count, coverage):
        """Tiles of texts whose pairs of seeds are listed."""
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(left, count) + nth
        place, item, word = np.repeat(hit, count), self.of_item[entry], self.of_word[entry]
        doc = np.searchsorted(begins, place, "right") - 1
        # hashes can collide: compare the words
        same = np.ones(len(place), dtype=bool)
        for j in range(SEED_WORDS):
            same &= known[place + j] == self.flat[self.base[item] + word + j]
        doc, item, place, word = doc[same], item[same], place[same], word[same]
        order = np.lexsort((place, place - word, item, doc))
        doc, item, place, word = doc[order], item[order], place[order], word[order]
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
            if a < b:
                name, own = self.items[item[a]]
                # words in no seed are in no tile
                reach = np.zeros(len(own), dtype=bool)
                for j in range(SEED_WORDS):
                    reach[word[a:b] + j] = True
                if reach.sum() >= coverage * len(own):
                    tiles = tile(place[a:b], word[a:b])
                    if sum(t[0] for t in tiles) >= coverage * len(own):
                        yield int(doc[a]), name, len(own), tiles

    def _crowded(self, doc, text, hit, left, count, coverage):
        """Tiles of one text that has too many pairs with all items together, item by item."""
        first = np.unique(left, return_index=True)[1]
        times = np.bincount(np.unique(left, return_inverse=True)[1])
        spread = count[first]
        entry = np.repeat(left[first], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        item, many = self.of_item[entry], np.repeat(times, spread)
        total = np.bincount(item, many, minlength=len(self.items))
        for i in np.flatnonzero(total).tolist():
            name, own = self.items[i]
            mine = entry[item == i]
            reach = np.zeros(len(own), dtype=bool)
            for j in range(SEED_WORDS):
                reach[self.of_word[mine] + j] = True
            if reach.sum() < coverage * len(own):
                continue
            if total[i] > self.pairs:
                tiles = tile_by_length(text, own)
            else:
                seed, place = self.seeds[mine], np.flatnonzero(np.isin(self.roll(text), self.seeds[mine]))
                order = np.argsort(seed, kind="stable")
                h = self.roll(text)[place]
                low, high = np.searchsorted(seed[order], h, "left"), np.searchsorted(seed[order], h, "right")
                n = high - low
                met = mine[order][np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                place, word = np.repeat(place, n), self.of_word[met]
                same = np.ones(len(place), dtype=bool)
                for j in range(SEED_WORDS):
                    same &= text[place + j] == own[word + j]
                place, word = place[same], word[same]
                order = np.lexsort((place, place - word))
                tiles = tile(place[order], word[order]) if len(place) else []
            if sum(t[0] for t in tiles) >= coverage * len(own):
                yield doc, name, len(own), tiles


def tile_by_length(text: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """The tiles of :func:`tile`, without a list of pairs: the greatest length with a common unmarked run is found by
    halving, as a run of any length holds shorter ones, each length tested by Karp-Rabin hashes of all runs."""
    both = [x.astype(np.uint64) for x in (text, item)]
    power, undo = (np.full(max(map(len, both)) + 1, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
    power[0] = undo[0] = 1
    power, undo = np.cumprod(power), np.cumprod(undo)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64))) for x in both]
    marked = [np.zeros(len(x), dtype=bool) for x in both]

    def runs(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where unmarked runs of ``n`` words begin, and their hashes."""
        marks = np.concatenate(([0], np.cumsum(marked[side])))
        at = np.flatnonzero(marks[n:] == marks[:-n])
        return at, (sums[side][at + n] - sums[side][at]) * undo[at]

    def common(n: int) -> tuple[int, int] | None:
        at, h = runs(1, n)
        spots, other = runs(0, n)
        for k in np.flatnonzero(np.isin(h, other)).tolist():
            for p in spots[other == h[k]][:1].tolist():
                if (both[0][p : p + n] == both[1][at[k] : at[k] + n]).all():
                    return int(at[k]), p
        return None

    tiles, high = [], min(map(len, both))
    while high >= least:
        low, found = least, common(least)
        if not found:
            break
        while low < high:
            middle = (low + high + 1) // 2
            if got := common(middle):
                low, found = middle, got
            else:
                high = middle - 1
        marked[1][found[0] : found[0] + low] = True
        marked[0][found[1] : found[1] + low] = True
        tiles.append((low, *found))
    return tiles


def tile(place: np.ndarray, word: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles ``(length, position in the item, position in the text)`` from seeds sorted by diagonal, then position.

    The longest match of unmarked words is marked first, ties at the earliest place in the item, then in the text. A
    match that marks have cut is taken up again with what is left of it.
    """
    breaks = np.flatnonzero((np.diff(place - word) != 0) | (np.diff(place) != 1)) + 1
    heap = []
    for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(place)], strict=True):
        heap.append((-(b - a + least - 1), int(word[a]), int(place[a])))
    heapq.heapify(heap)
    in_item, in_text, tiles = set(), set(), []
    while heap:
        n, i, p = heapq.heappop(heap)
        free = [i + k not in in_item and p + k not in in_text for k in range(-n)]
        if all(free):
            in_item.update(range(i, i - n))
            in_text.update(range(p, p - n))
            tiles.append((-n, i, p))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= least:
                    heapq.heappush(heap, (start - k, i + start, p + start))
                start = None
    return tiles


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str):
    """One broadcast index for each block of the benchmark; one at least, which may be empty."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in block.collect()]))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``(id, item_id, covered, item_words, coverage, tiles)`` of each row and item whose tiles cover ``coverage`` of the item or more.

    Words are runs of letters, digits and underscores in lower case. Every word of every text is searched. Items of
    fewer than five words are found in texts that have just these words. The benchmark is held in blocks of bounded
    size, each broadcast once; more blocks mean more passes, not more memory. Null and empty texts and items match
    nothing; repeated rows are reported each; other columns are ignored; empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = benchmark.schema[item_col].dataType
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id {kind.simpleString()}, covered int, item_words int, coverage double, tiles int"
    parts = [rows.mapInArrow(_search(index, coverage, to_arrow_type(kind)), schema) for index in _indexes(benchmark, item_col, item_text_col)]
    return functools.reduce(DataFrame.unionByName, parts)


def _search(index, coverage: float, item_type: pa.DataType):
    def run(batches):
        for batch in slices(batches):
            found = list(index.value.search(batch.column(1).to_pylist(), coverage))
            if found:
                covered = [sum(t[0] for t in tiles) for *_, tiles in found]
                columns = [
                    batch.column(0).take(pa.array([x[0] for x in found])),
                    pa.array([x[1] for x in found], item_type),
                    pa.array(covered, pa.int32()),
                    pa.array([x[2] for x in found], pa.int32()),
                    pa.array([c / x[2] for c, x in zip(covered, found, strict=True)], pa.float64()),
                    pa.array([len(x[3]) for x in found], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "covered", "item_words", "coverage", "tiles"])

    return run


def without_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item is found. Rows are judged where they are, by their own text: nothing is shuffled."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col):

        def run(batches, index=index):
            for batch in slices(batches):
                stays = np.ones(batch.num_rows, dtype=bool)
                stays[[x[0] for x in index.value.search(batch.column(at).to_pylist(), coverage)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
