"""Harmonic packing of token sequences: bins of a length class are filled with a fixed number of pieces.

A piece of n tokens is of class k = capacity // n, the number of such pieces that a bin is sure to hold. Bins of class
k take k pieces and close. A piece that would leave over ``1 / SLACK`` of its bins empty is cut at capacity // (k + 1)
tokens, which is the largest size of the next class, and the rest is treated alike: it is below capacity / (k * (k + 1)),
so few cuts do. Every worker fills bins on its own and meets no other: nothing is shuffled. At its end it holds at most one open
bin a class; those go whole, largest first, into the first sequence with room.

Ids come from the tokenizer, by way of ``segments``: a task keeps ids of known segments, and a text's ids are joined
from those of its segments. Only open bins and one batch of texts are in memory.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each, a null doc_id is kept; a very
long text is encoded in slices and cut into full sequences (its own ids are held at once); documents of equal length
take places in the order they are read; an empty table gives no rows; other columns are not read. Sequence ids are
unique, not gapless: the worker's number times 2^33 plus the sequence's number there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratesift.llm.segments import CUT, MARKS, ByteLevel, Kept, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: A piece is cut where the bins of its class would be emptier than one part in so many.
SLACK = 16
#: Segments whose ids a process keeps, twice over.
KEPT = 700_000
#: Code points worked on at once, and rows.
BATCH_CHARS, BATCH_ROWS = 1 << 21, 4096
OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def lengths_of(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if (capacity - k * rest) * SLACK <= capacity:
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Bins:
    """A worker's bins; a piece is any tuple whose third value is its length."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.sequences = capacity, {}, 0

    def _closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        """(piece, number of its sequence, offset there)"""
        offset = 0
        for piece in pieces:
            yield piece, self.sequences, offset
            offset += piece[2]
        self.sequences += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self._closed(held)

    def close(self) -> Iterator[tuple]:
        """Open bins, at most one a class, whole into the first sequence with room, largest first."""
        rest: list[list] = []
        bins = sorted(((sum(p[2] for p in held), k) for k, held in self.open.items()), reverse=True)
        for size, k in bins:
            place = next((r for r in rest if r[0] + size <= self.capacity), None)
            if place is None:
                rest.append(place := [0, []])
            place[0] += size
            place[1] += self.open[k]
        self.open = {}
        for _, pieces in rest:
            yield from self._closed(pieces)


class TextIds:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, serialized: str):
        self.model = ByteLevel(serialized, plain=False)
        self.kept = Kept(f"ids of {hash(serialized)}", self.model.fast_ids, MARKS, lambda core, line: core + line[4:], self.model.whole, KEPT)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """A text that begins with no blank has the ids of a line of its own, but for the line feed's."""
        led, heads, owner = [], [], []
        for i, text in enumerate(texts):
            heads.append(b"")
            first, *more = slices(text)
            if first[:1].isspace():
                cut = CUT.search(first)
                head = first[: cut.start()] if cut else first
                heads[i], first = self.model.fast_ids([head])[0], first[len(head):]
            elif first:
                first = "\n" + first
                heads[i] = None
            for piece in (first, *more):
                if piece:
                    led.append(piece)
                    owner.append(i)
        out = [[h or b""] for h in heads]
        for i, ids in zip(owner, self.kept.joined(led)):
            out[i].append(ids)
        joined = [b"".join(values) for values in out]
        return [ids[4:] if head is None else ids for head, ids in zip(heads, joined)]


def batched(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, end row) of rows that together hold about as much text as is worked on at once."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > BATCH_CHARS or i - start >= BATCH_ROWS):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of documents placed in sequences.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers; ``start`` counts the document's ids before.
    The tokenizer's file is read by the driver and sent to the executors once.
    """
    with open(tokenizer, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # one file of a fixed vocabulary
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = TextIds(sent.value), Bins(capacity)
        base = TaskContext.get().partitionId() << 33

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            columns = zip(*((*piece, base + number, offset) for piece, number, offset in placed))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = [c.split()[0] for c in OUT.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for start, end in batched(batch["text"]):
                part, placed = batch.slice(start, end - start), []
                texts = [t or "" for t in part["text"].to_pylist()]
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(texts)):
                    ids += last
                    n, at = len(ids) // 4, 0
                    for length in lengths_of(n, capacity):
                        placed += bins.add((doc_id, at, length, ids[4 * at: 4 * (at + length)], n))
                        at += length
                if placed:
                    yield rows(placed)
        if placed := list(bins.close()):
            yield rows(placed)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
