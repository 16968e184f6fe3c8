"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last ROLL bytes ends a chunk wherever it falls below one in 2^k values; every chunk gives one
of 64 characters. k, the block size's exponent, is the smallest from MIN_LEVEL on that leaves at most LONGEST chunks,
so that signature has about 32 to 64 characters for any length. A fingerprint is ``k:`` and the signatures at k,
k + 1 and k + 2, each of the whole text. Edits change the chunks that they touch and leave the others alone.

Two fingerprints are compared at the block sizes that both hold: likeness is one less the edit distance (insertions
and deletions) over both lengths, the best of the compatible sizes, and none unless the signatures share a run of
RUN characters (all of them, if shorter).

Defined cases: null is an empty text; documents follow each other by (doc_id, text), null ids first, so repeated ids
are defined too; a table of one document is followed by itself; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratesift.llm.columns import text_or_empty
from ratesift.llm.hashing import BYTE_VALUE, MIX_A, RADIX, U, powers
from ratesift.session import durable

ROLL, MIN_LEVEL, LONGEST, SIZES, RUN = 7, 2, 64, 3, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
UNRADIX = U(pow(int(RADIX), -1, 1 << 64))
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edge int, part int, text string"
)


class Fingerprinter:
    """Keeps tables of powers as long as the longest text so far."""

    def __init__(self) -> None:
        self.up, self.down = powers(1 << 16), powers(1 << 16, UNRADIX)

    def __call__(self, text: bytes) -> str:
        n = len(text)
        if not n:
            return f"{MIN_LEVEL}" + ":" * SIZES
        if n > len(self.up):
            self.up, self.down = powers(2 * n), powers(2 * n, UNRADIX)
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUE[np.frombuffer(text, np.uint8)] * self.up[:n], out=sums[1:])
        window = sums[1:].copy()
        window[ROLL:] -= sums[1: n + 1 - ROLL] if n > ROLL else 0
        window[ROLL:] *= self.down[: max(n - ROLL, 0)]  # as if the window began at the text's start
        rolled = (window ^ (window >> U(32))) * MIX_A
        level = max(MIN_LEVEL, (n // LONGEST).bit_length())
        ends = self._ends(rolled, level)
        while level > MIN_LEVEL and len(finer := self._ends(rolled, level - 1)) < LONGEST:
            level, ends = level - 1, finer
        while len(ends) >= LONGEST:
            level += 1
            ends = ends[rolled[ends] < U(1 << (64 - level))]
        sizes = (ends[rolled[ends] < U(1 << (64 - level - i))] for i in range(SIZES))
        return ":".join([str(level), *(self._signature(sums, e) for e in sizes)])

    @staticmethod
    def _ends(rolled: np.ndarray, level: int) -> np.ndarray:
        return np.flatnonzero(rolled < U(1 << (64 - level)))

    def _signature(self, sums: np.ndarray, ends: np.ndarray) -> str:
        n = len(sums) - 1
        cuts = ends + 1
        if not len(cuts) or cuts[-1] < n:
            cuts = np.append(cuts, n)
        starts = np.concatenate(([0], cuts[:-1]))
        chunks = (sums[cuts] - sums[starts]) * self.down[starts]
        chunks = (chunks ^ (chunks >> U(29))) * MIX_A
        return ALPHABET[(chunks >> U(58)).astype(np.int64)].tobytes().decode()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or {a[i: i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i: i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))  # 1 - distance / (both lengths)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    (level_a, *signatures_a), (level_b, *signatures_b) = a.split(":"), b.split(":")
    at_a = {int(level_a) + i: s for i, s in enumerate(signatures_a)}
    at_b = {int(level_b) + i: s for i, s in enumerate(signatures_b)}
    return max((signature_likeness(at_a[k], at_b[k]) for k in at_a.keys() & at_b.keys()), default=0.0)


def _compared(make: Fingerprinter, doc_id, text: str, own: str, after: str, next_own: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    data = edited.encode()
    changed = own if edited == text else make(data)
    return (doc_id, len(text), hashlib.sha256(data).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_own))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    names = [part.split()[0] for part in OUT.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each document with the next one of its range; hand on the first (edge 0) and the last (edge 1)."""
    make, part, before, seen = Fingerprinter(), TaskContext.get().partitionId(), None, False
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            own = make(text.encode())
            if before is None:
                rows.append((doc_id, None, None, None, None, None, None, 0, part, text))
            else:
                rows.append((*_compared(make, *before, text, own), None, None, None))
            before = (doc_id, text, own)
        if rows:
            yield _batch(rows)
    if before is not None:
        yield _batch([(before[0], *[None] * 6, 1, part, before[1])])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Fingerprinter()
    for batch in batches:
        rows = [
            (*_compared(make, doc_id, text, make(text.encode()), after, make(after.encode())), None, None, None)
            for doc_id, text, after in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "after")))
        ]
        if rows:
            yield _batch(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its latter half replaced by the next document's start)."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(ranges, "doc_id", "text").sortWithinPartitions("doc_id", "text")
    compared = durable(ordered.mapInArrow(_in_order, OUT), "fingerprints")
    edges = compared.where("edge IS NOT NULL").select("doc_id", "text", "edge", "part")
    order = Window.orderBy("part", "edge")  # two documents for each range
    after = F.coalesce(F.lead("text").over(order), F.first("text").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = edges.withColumn("after", after).where("edge = 1").select("doc_id", "text", "after")
    every = compared.where("edge IS NULL").unionByName(last.mapInArrow(_edges, OUT))
    return every.drop("edge", "part", "text")
