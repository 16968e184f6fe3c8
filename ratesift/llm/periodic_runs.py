"""Periodic runs of words by descending-LCP Kruskal over the suffixes of a text.

A text's suffixes are sorted by doubled ranks, which also give the common prefix (LCP) of neighbours in that order.
Neighbours are then united by decreasing LCP, as Kruskal's algorithm takes edges: a class at level l is the ordered set
of the positions whose next l words are equal, and the smaller of two classes moves into the larger. Two positions that
become neighbours in their set at level l, at distance d <= l, hold a stretch of period d that ends l words after the
second; as they were apart before, it goes no further. If the words ahead of both differ, the first is the start of a run, and
every run is met there once: a position between them would have to start an equal word of d letters inside its square, which only a shorter
period allows. For the same reason d is the smallest period.

A run of ``min_length`` words and ``min_periods`` periods or more has positions whose LCP is at least ``least_level``;
lower levels seed none, so the union ends there. Texts that hold no stretch of so many words twice, by a hash with no false
negatives, have no such class and skip the sort. Words are compared exactly.

Defined cases: a null or empty text has no words and no runs; repeated rows are worked on each, a null doc_id is kept;
a text may be of any length and is searched whole, with about 100 bytes of memory a word while runs are sought; runs that start
together are ordered by period; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratesift.llm.hashing import STEP, U, mix
from ratesift.llm.packing import batched

OUT = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def least_level(min_length: int, min_periods: int) -> int:
    """The least LCP that a run's first two period starts have: over all periods q, max(min_length, min_periods * q) - q."""
    return min(max(min_length, min_periods * q) - q for q in range(1, min_length + 1))


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, LCP of each with the next one in that order)"""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while rank.max() < n - 1:
        key = (rank + 1) * (n + 1)
        key[: max(n - width, 0)] += rank[width:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for level in reversed(range(len(levels))):
        inside = np.flatnonzero(np.maximum(left, right) < n)
        same = inside[levels[level][left[inside]] == levels[level][right[inside]]]
        for moved in (left, right, common):
            moved[same] += 1 << level
    return order, common


def runs_of(words: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``words`` are numbers."""
    least = least_level(min_length, min_periods)
    if len(words) < max(min_length, min_periods):
        return []
    order, common = suffixes(words)
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    numbers = words.tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = parent[i]
        return i

    for a, b, level in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist()):
        a, b = root(a), root(b)
        large, small = members.pop(a, [a]), members.pop(b, [b])
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        members[a] = large
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            beside = [(large[at - 1], x)] if at and (not k or large[at - 1] != small[k - 1]) else []
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                beside.append((x, large[at]))
            for i, j in beside:
                d = j - i
                if d <= level and d + level >= max(min_length, min_periods * d) and (not i or numbers[i - 1] != numbers[j - 1]):
                    found.append((i, d + level, d))
            large.insert(at, x)
    return sorted(set(found))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: not those of a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def repeating(texts: list[list[bytes]], width: int) -> list[int]:
    """Indexes of the texts that hold some ``width`` words twice; a hash may add some that don't."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if total < width:
        return []
    hashes = mix(np.fromiter((hash(w) for t in texts for w in t), np.int64, total).view(U))
    done, factor = 1, np.array([STEP])
    while done < width:  # of ``done`` words at each place, then of as many more
        more = min(done, width - done)
        hashes = hashes[: len(hashes) - more] * factor + hashes[more:]
        factor = factor * factor
        done += more
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    inside = np.flatnonzero(np.arange(len(hashes)) + width <= ends[: len(hashes)])
    marked = mix(hashes[inside] ^ (owner[inside].astype(U) * STEP))
    ordered = np.sort(marked)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    place = np.minimum(np.searchsorted(twice, marked), len(twice) - 1)
    return np.unique(owner[inside][twice[place] == marked]).tolist()


def periodic_runs(docs: DataFrame, min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): maximal stretches with a smallest period, and the text with one period of each.

    Words are divided by the bytes 0x20 and 0x09 to 0x0D; ``collapsed`` holds those that stay, joined by one blank.
    """
    if min_length < 2 or min_periods < 2:
        raise ValueError("a run has two words and two periods at least")
    width = max(1, least_level(min_length, min_periods))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in batched(batch["text"]):
                part = batch.slice(start, end - start)
                texts = [(t or "").encode().split() for t in part["text"].to_pylist()]  # bytes split at just those blanks
                runs: list[list] = [[] for _ in texts]
                collapsed = [b" ".join(words) for words in texts]
                for i in repeating(texts, width):
                    numbers: dict[bytes, int] = {}
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in texts[i]), np.int64, len(texts[i]))
                    if runs_here := runs_of(ids, min_length, min_periods):
                        runs[i] = [{"start": s, "length": n, "period": q} for s, n, q in runs_here]
                        stay = kept_words(len(ids), runs_here)
                        collapsed[i] = b" ".join([w for w, k in zip(texts[i], stay.tolist()) if k])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.record_batch([
                    part["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
