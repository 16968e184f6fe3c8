"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Items and documents become sequences of SHINGLE-word shingles. A window as long as an item slides over each document;
items of nearly the same length share their windows, and windows are STEPS to a length apart. A window's SimHash comes
from running sums of its shingles' bits, packed several to a machine word, so that each costs a few subtractions. The
64 bits are cut into four blocks of 16: a fingerprint within RADIUS of an item's differs from it in at most
RADIUS / 4 bits of some block, so four tables from a block's value to the items near it find all of them. Those
windows, moved by up to a step, are then compared with the item exactly: weighted Jaccard over the counts of shingles.

Items are the stated query set: they travel with the tasks in blocks of ITEM_BLOCK, one pass over the documents each.

Defined cases: items and documents of fewer than SHINGLE words match nothing; null is an empty text; a document a
little shorter than an item is one window; of windows equally like an item the first compared counts; a very long text
is a piece of its own; repeated documents are each compared; a null item_id or doc_id is carried; empty tables give no
rows; other columns are not read. A table of more than MAX_ITEMS items is refused: give it in several parts and unite
the results.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratesift.llm.hashing import U, Words, mix, pieces

SHINGLE, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 19, 4
STEPS, CLASS_RATIO = 8, 1.1
ITEM_BLOCK, MAX_ITEMS = 4096, 1_000_000
OUT = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def spread(lane: int) -> np.ndarray:
    """For every value of 64 / lane... bits held by one machine word: those bits, one in each lane."""
    per = 64 // lane
    values = np.arange(1 << per, dtype=U)
    return sum((((values >> U(j)) & U(1)) << U(lane * j) for j in range(per)), np.zeros(1 << per, U))


class BitSums:
    """Running sums of the bits of shingle hashes: SimHashes of any windows by subtraction."""

    def __init__(self, hashes: np.ndarray, lane: int):
        self.lane, self.per = lane, 64 // lane
        table, low = spread(lane), U((1 << self.per) - 1)
        self.sums = np.zeros((len(hashes) + 1, lane), U)
        for g in range(lane):
            np.cumsum(table[(hashes >> U(g * self.per)) & low], out=self.sums[1:, g])

    def simhash(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Bits set in more than half of the ``length`` shingles from every start on."""
        counts = np.take(self.sums, starts + length, axis=0)
        counts -= np.take(self.sums, starts, axis=0)
        more = counts.view(f"<u{self.lane // 8}") > length // 2
        return np.packbits(more.reshape(-1), bitorder="little").view("<u8")


def lane_for(length: int) -> int:
    return 8 if length < 1 << 8 else 16 if length < 1 << 16 else 32


def near_values(distance: int) -> np.ndarray:
    """All 16-bit differences of at most so many bits."""
    return np.array([sum(1 << b for b in bits) for n in range(distance + 1) for bits in combinations(range(16), n)], np.int64)


class SizeClass:
    """Items of nearly one length with their Hamming block tables."""

    def __init__(self, items: list[tuple]):
        self.items = items
        self.words = int(np.median([i[1] for i in items]))
        self.smallest = min(i[1] for i in items)
        self.step = max(1, self.words // STEPS)
        self.slack = self.step + max(abs(i[1] - self.words) for i in items)
        self.prints = np.array([i[3] for i in items], U)
        self.tables: list[list[np.ndarray]] = []
        differences = near_values(RADIUS // BLOCKS)
        for first in range(0, len(items), 64):
            group = self.prints[first: first + 64]
            kind = np.uint8 if len(group) <= 8 else U
            tables = [np.zeros(1 << 16, kind) for _ in range(BLOCKS)]
            for k, value in enumerate(group):
                for b, t in enumerate(tables):
                    t[int(value >> U(16 * b)) & 0xFFFF ^ differences] |= kind(1 << k)
            self.tables.append(tables)

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(windows, item) for every item and all windows within RADIUS of it."""
        blocks = np.ascontiguousarray(prints.astype("<u8").view("<u2").reshape(-1, BLOCKS).T)
        for g, tables in enumerate(self.tables):
            mask = tables[0][blocks[0]]
            for b in range(1, BLOCKS):
                mask |= tables[b][blocks[b]]
            some = np.flatnonzero(mask)
            mask, held = mask[some], prints[some]
            for k in range(min(64, len(self.items) - 64 * g)):
                maybe = np.flatnonzero(mask & mask.dtype.type(1 << k))
                close = maybe[np.bitwise_count(held[maybe] ^ self.prints[64 * g + k]) <= RADIUS]
                if len(close):
                    yield some[close], 64 * g + k


def weighted_likeness(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (a.total() + b.total() - common)


def prepared(items: list[tuple[int, str]]) -> list[tuple]:
    """(item_id, words, shingle counts, fingerprint) of the items that are long enough."""
    out = []
    for _, _, data, offsets in pieces(pa.array([t for _, t in items], pa.large_string())) if items else ():
        words = Words(data, offsets)
        shingles, _ = words.shingles(SHINGLE)
        for d in range(len(offsets) - 1):
            lo, hi = int(words.bounds[d]), int(words.bounds[d + 1])
            n = hi - lo - SHINGLE + 1
            if n > 0:
                own = shingles[lo: lo + n]
                print_ = BitSums(mix(own), lane_for(n)).simhash(np.array([0]), n)[0]
                out.append((hi - lo, Counter(own.tolist()), print_))
            else:
                out.append(None)
    return [(i, *p) for (i, _), p in zip(items, out) if p is not None]


def size_classes(items: list[tuple]) -> list[SizeClass]:
    groups = defaultdict(list)
    for item in items:
        groups[round(math.log(item[1]) / math.log(CLASS_RATIO))].append(item)
    return [SizeClass(g) for _, g in sorted(groups.items())]


def windows(words: Words, size: int, step: int, smallest: int) -> Iterator[tuple[np.ndarray, int]]:
    """(starts, shingles) of windows of ``size`` words: a grid and every text's first and last; then of short texts.

    A text may be shorter than a window as far as it can still be like an item of ``smallest`` words.
    """
    first, last = words.bounds[:-1], words.bounds[1:]
    length = last - first
    grid = np.arange(0, len(words.hashes), step)
    grid = grid[np.repeat(last, length)[grid] - grid >= size]
    long = length >= size
    yield np.concatenate((grid, first[long], last[long] - size)), size - SHINGLE + 1
    for n in np.unique(length[(length < size) & (length >= max(SHINGLE, THRESHOLD * smallest))]):
        yield first[length == n], int(n) - SHINGLE + 1


def _half_shared(shingles: np.ndarray, starts: np.ndarray, count: int, wanted: Counter) -> np.ndarray:
    """Which windows have half of their shingles in ``wanted``: fewer can't reach the threshold by moving a step."""
    own, held = np.array(sorted(wanted), U), shingles[starts[:, None] + np.arange(count)]
    at = np.minimum(np.searchsorted(own, held), len(own) - 1)
    return 2 * (own[at] == held).sum(axis=1) >= count


def _hits(words: Words, classes: list[SizeClass]) -> dict[tuple[int, object], tuple[float, int, int]]:
    """Best (likeness, start, words) per (text, item) in a piece of texts."""
    shingles, _ = words.shingles(SHINGLE)
    bits, sums, best = mix(shingles), {}, {}
    for c in classes:
        lane = lane_for(c.words)
        if lane not in sums:
            sums[lane] = BitSums(bits, lane)
        for starts, count in windows(words, c.words, c.step, c.smallest):
            for close, k in c.near(sums[lane].simhash(starts, count)):
                item, size, wanted, _ = c.items[k]
                near = starts[close]
                for at in near[_half_shared(shingles, near, count, wanted)].tolist():
                    d = int(np.searchsorted(words.bounds, at, "right")) - 1
                    lo, hi = int(words.bounds[d]), int(words.bounds[d + 1])
                    for start in range(max(lo, at - c.slack), min(at + c.slack, hi - SHINGLE) + 1):
                        end = min(start + size, hi)
                        like = weighted_likeness(Counter(shingles[start: end - SHINGLE + 1].tolist()), wanted)
                        if like >= THRESHOLD and like > best.get((d, item), (0,))[0]:
                            best[d, item] = (like, start - lo, end - start)
    return best


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window per document and item that match."""
    rows = [(r.item_id, r.text) for r in items.select("item_id", "text").limit(MAX_ITEMS + 1).collect()]
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for first in range(0, max(len(rows), 1), ITEM_BLOCK):
        block = prepared(rows[first: first + ITEM_BLOCK])

        def compare(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            classes = size_classes(block)
            for batch in batches:
                for row, _, data, offsets in pieces(batch["text"]):
                    best = _hits(Words(data, offsets), classes) if classes else {}
                    if best:
                        ids = batch["doc_id"]
                        yield pa.record_batch([
                            pa.array([ids[row + d].as_py() for d, _ in best], pa.int64()),
                            pa.array([i for _, i in best], pa.int64()),
                            *(pa.array(c, t) for c, t in zip(zip(*best.values()), (pa.float64(), pa.int64(), pa.int64()))),
                        ], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        hits = texts.mapInArrow(compare, OUT)
        found = hits if found is None else found.unionByName(hits)
    return found
