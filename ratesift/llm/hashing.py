"""Words and shingles of Arrow batches of texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Increment and multipliers of the splitmix64 generator.
STEP, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * STEP)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_VALUE = BYTE_VALUE[FOLD]
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All single bytes but letters and digits; parts of longer characters count as letters.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
RADIX = U(0xD6E8FEB86659FD93)


def powers(n: int, base: np.uint64 = RADIX) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows' texts) for consecutive rows of about ``size`` bytes; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


class Words:
    """Words of consecutive texts: byte spans, hashes, and ``bounds[d]:bounds[d + 1]`` for the words of text d.

    Words hold no byte of ``gaps``; they are compared with A to Z lower-cased.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = BLANK, prefixes: tuple[int, ...] = ()):
        inside = ~gaps[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        self.prefixes: list[np.ndarray] = []
        if not len(lengths):
            self.hashes = np.zeros(0, U)
            self.prefixes = [self.hashes for _ in prefixes]
            return
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        terms = FOLDED_VALUE[data[inside]] * powers(int(lengths.max()))[place]
        self.hashes = mix(np.add.reduceat(terms, begin) + lengths.astype(U) * STEP)
        for n in prefixes:
            self.prefixes.append(mix(np.add.reduceat(np.where(place < n, terms, U(0)), begin) ^ U(n)))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words from every word on, and whether those k words are in one text."""
        n = len(self.hashes)
        out, whole = np.zeros(n, U), np.zeros(n, bool)
        if n >= k:
            total = np.zeros(n - k + 1, U)
            for j in range(k):
                total = (total + self.hashes[j: n - k + 1 + j]) * RADIX
            out[: n - k + 1] = mix(total + U(k))
            left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(n)
            whole = left >= k
        return out, whole
