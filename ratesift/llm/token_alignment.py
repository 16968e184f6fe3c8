"""Alignment of two tokenizers' tokens over the bytes they spell.

A is a byte-level tokenizer, B a SentencePiece model with byte fallback. Both spell a blank and the text. Token ends come
from the libraries' own spans, A's character offsets and the spans of B's immutable proto, as coarse cuts. Tokens between
two cuts, which are the parts of a character of several bytes and B's byte tokens, end where their decoded bytes end. Where
the decoded bytes aren't the text, there are no tokens.

Neither tokenizer merges over the cuts of ``segments``, so links and groups of a text are those of its segments. New
segments are aligned many at a time, as one text, with sorted arrays; known ones are looked up by process.

Corpus-wide counts of linked ids never meet all documents in one place. Documents are put in blocks of about
``BLOCK_CHARS`` code points; a block keeps its pairs of ids once, and its documents as (pair's place, times). Blocks' pairs are
summed by pair, the sums go back to the blocks that hold the pair, and each block settles its documents. The blocks
are written to the shared folder before.

Defined cases: a null or empty text, and one whose tokens spell other bytes (a literal U+2581), has no tokens: zeros and an empty digest;
strings of special tokens are plain text; a very long text is aligned in slices and is a block of its own;
repeated rows count each; a null doc_id is kept; pairs that tie for the highest count of their B id are all best; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratesift.llm.packing import batched
from ratesift.llm.segments import ByteLevel, Kept, slices
from ratesift.llm.sentencepiece_codec import MARK, Vocabulary
from ratesift.session import durable

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a block's documents; a longer document is a block.
BLOCK_CHARS = 8 << 20
#: Segments whose links a process keeps, twice over.
KEPT = 200_000
#: A link's number: A id above B id, and above both whether an A token, a B token and a group begin.
BITS = 20
PAIR = (1 << 2 * BITS) - 1
NEW_A, NEW_B, NEW_GROUP = (1 << 2 * BITS + i for i in range(3))


class Misread(Exception):
    """Some segment's tokens don't spell it, or a library's spans contradict the bytes."""


class Aligner:
    """Links of segments: numbers of links in order, and the groups as text."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece

        self.a = ByteLevel(byte_level, plain=True)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        b = self.model
        if max(len(self.a.spelled), b.vocab_size()) >> BITS:
            raise ValueError(f"a vocabulary of more than 2^{BITS} ids")
        names = [b.id_to_piece(i) for i in range(b.vocab_size())]
        self.spelled = [
            bytes([int(p[1:-1], 16)]) if b.is_byte(i) else b"" if b.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)
        ]
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)
        if any(x != MARK and y == MARK or "\n" in (x, y) for p in names for x, y in zip(p, p[1:])):
            raise ValueError("a piece reaches over a blank or a line feed")
        self.after = {y for p in names for x, y in zip(p, p[1:]) if x.isalnum()}
        self.in_bytes = self._proto("é a")[0][1] == 2  # versions of the library differ

    def _proto(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, id) of B's tokens."""
        try:
            proto = self.model.encode(text, return_type="proto")
        except TypeError:
            proto = self.model.encode(text, out_type="immutable_proto")
        return [(p.begin, p.end, p.id) for p in proto.pieces]

    def _ends(self, coarse: np.ndarray, cut: np.ndarray, lengths: np.ndarray, strict: bool) -> np.ndarray:
        """Ends of tokens in bytes: the coarse cuts, and between them the decoded lengths from the last cut on."""
        spelled = np.cumsum(lengths)
        last = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))
        base = np.where(last >= 0, coarse[last] - spelled[last], 0)
        ends = spelled + base
        if not np.array_equal(ends, spelled):
            if strict:
                raise Misread
            return spelled
        return ends

    def tokens(self, text: str, strict: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, their ends, B ids, their ends) of a text that begins with a blank; ends count bytes."""
        data = text.encode()
        at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))  # of characters
        encoded = self.a.encode(text)
        a = np.array(encoded.ids, np.int64)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        whole = np.append(offsets[1:, 0] >= offsets[:-1, 1], True)  # the next token begins after this one's last character
        a_ends = self._ends(at[offsets[:, 1]], whole, self.a.lengths[a], strict)
        begin, end, b = np.array(self._proto(text[1:]), np.int64).reshape(-1, 3).T
        coarse = (end if self.in_bytes else at[end + 1] - 1) + 1
        b_ends = self._ends(coarse, end > begin, self.lengths[b], strict)
        if b"".join([self.spelled[i] for i in b.tolist()]) != data or b"".join([self.a.spelled[i] for i in a.tolist()]) != data:
            raise Misread
        return a, a_ends, b, b_ends

    def segments(self, texts: list[str]) -> list[tuple[bytes, str] | None]:
        """(links, groups) of segments that begin with a blank or line feed; None where tokens don't spell the segment."""
        try:
            return self._segments(texts, strict=len(texts) > 1)
        except Misread:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return self.segments(texts[:half]) + self.segments(texts[half:])

    def _segments(self, texts: list[str], strict: bool) -> list[tuple[bytes, str] | None]:
        ahead = "" if texts[0].startswith(" ") else " a"  # B puts a blank first
        a, a_ends, b, b_ends = self.tokens(ahead + "".join(texts), strict)
        stops = len(ahead) + np.cumsum([len(t.encode()) for t in texts])
        a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
        both = np.intersect1d(a_ends, b_ends)
        if not np.isin(stops, both).all():
            raise Misread
        first = np.searchsorted(b_ends, a_starts, "right")
        times = np.searchsorted(b_starts, a_ends, "left") - first
        row = np.repeat(np.arange(len(a)), times)
        column = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
        links = a[row] << BITS | b[column]
        links |= np.where(column == first[row], NEW_A, 0) | np.where(row == np.searchsorted(a_ends, b_starts, "right")[column], NEW_B, 0)
        links |= np.where(a_starts[row] == b_starts[column], NEW_GROUP, 0)
        data, a_names, b_names = links.astype("<i8").tobytes(), list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_cuts, b_cuts = np.searchsorted(a_ends, both, "right").tolist(), np.searchsorted(b_ends, both, "right").tolist()
        groups = [
            ",".join(a_names[i:j]) + "|" + ",".join(b_names[k:m])
            for i, j, k, m in zip([0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts)
        ]
        link_cuts = (8 * np.searchsorted(a_ends[row], stops, "right")).tolist()
        group_cuts = np.searchsorted(both, stops, "right").tolist()
        skip = [(int((a_ends[row] <= len(ahead)).sum()) * 8, int((both <= len(ahead)).sum()))] if ahead else [(0, 0)]
        return [
            (data[i:j], ";".join(groups[k:m]))
            for i, j, k, m in zip([skip[0][0], *link_cuts], link_cuts, [skip[0][1], *group_cuts], group_cuts)
        ]


def with_tail(core: tuple | None, line: tuple | None) -> tuple | None:
    """A segment's links and groups with those of the line that follows, but for its line feed."""
    return core and line and (core[0] + line[0][8:], f"{core[1]};{line[1].split(';', 1)[1]}")


class TextLinks:
    """(links, groups as text) of whole texts; None where a text has no tokens."""

    def __init__(self, byte_level: str, pieces: bytes):
        aligner = Aligner(byte_level, pieces)
        marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in aligner.after)
        self.kept = Kept(f"links of {hash((byte_level, pieces))}", aligner.segments, marks, with_tail, (), KEPT)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, list[str]] | None]:
        led, owner = [], []
        for i, text in enumerate(texts):
            if text:
                pieces = list(slices(" " + text))
                led += pieces
                owner += [i] * len(pieces)
        found: list[list] = [[] for _ in texts]
        for i, values in zip(owner, self.kept.values(led)):
            found[i] += values
        return [
            (np.frombuffer(b"".join([v[0] for v in values]), "<i8"), [v[1] for v in values]) if values and None not in values else None
            for values in found
        ]


class Block:
    """Documents of a block: for each, the pairs it links and how often."""

    def __init__(self, number: int):
        self.number, self.rows, self.keys, self.times, self.chars = number, [], [], [], 0

    def add(self, rows: list[tuple], links: list[np.ndarray], chars: int) -> None:
        """Some documents: their finished columns and the numbers of their links."""
        owner = np.repeat(np.arange(len(self.rows), len(self.rows) + len(rows)), [len(x) for x in links])
        small = owner - len(self.rows)  # a batch's documents and a pair fit 63 bits
        keys = np.sort(small << 2 * BITS | np.concatenate(links) & PAIR) if links else np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.times.append(np.diff(np.append(first, len(keys))))
        self.keys.append((keys[first] >> 2 * BITS) + len(self.rows))
        self.keys.append(keys[first] & PAIR)
        self.rows += rows
        self.chars += chars

    def written(self) -> Iterator[pa.RecordBatch]:
        """One row for the block's pairs, and one for each document with the places of its pairs."""
        owner, pair, times = np.concatenate(self.keys[::2]), np.concatenate(self.keys[1::2]), np.concatenate(self.times)
        pairs, place = np.unique(pair, return_inverse=True)
        total = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
        cuts = np.searchsorted(owner, np.arange(len(self.rows) + 1))
        places, often = place.astype(np.min_scalar_type(max(len(pairs), 1))), times.astype(np.min_scalar_type(int(times.max(initial=1))))
        cells = [(places[i:j].tobytes(), often[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
        n = len(self.rows)
        whole = list(zip(*self.rows))
        yield pa.record_batch(
            [pa.array([self.number] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(whole, KINDS)), pa.array([x for x, _ in cells], pa.binary()),
             pa.array([x for _, x in cells], pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=COLUMNS)
        yield pa.record_batch(
            [pa.array([self.number], pa.int64()), *(pa.nulls(1, k) for k in KINDS), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
             pa.array([pairs], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64()))], names=COLUMNS)


KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
STORED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, "
    "pairs array<bigint>, totals array<bigint>"
)
COLUMNS = [c.split()[0] for c in STORED.split(", ")]
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def sent_models(docs: DataFrame, byte_level: str, pieces: str):
    """Both vocabularies' files, read by the driver and sent to the executors once; their size is fixed."""
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def blocks_of(docs: DataFrame, digest: bool, byte_level: str, pieces: str) -> DataFrame:
    sent = sent_models(docs, byte_level, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links_of = TextLinks(*sent.value)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            for start, end in batched(batch["text"]):
                part = batch.slice(start, end - start)
                texts = [t or "" for t in part["text"].to_pylist()]
                rows, links = [], []
                for doc_id, aligned in zip(part["doc_id"].to_pylist(), links_of(texts)):
                    codes, groups = aligned or (np.zeros(0, np.int64), [])
                    counts = [int(((codes & flag) != 0).sum()) for flag in (NEW_A, NEW_B, NEW_GROUP)]
                    text = ";".join(groups)
                    rows.append((doc_id, *counts, len(codes), hashlib.sha256(text.encode()).hexdigest() if digest and text else text))
                    links.append(codes)
                chars = sum(map(len, texts))
                if block.rows and block.chars + chars > BLOCK_CHARS:
                    yield from block.written()
                    block = Block(number := number + 1)
                block.add(rows, links, chars)
        if block.rows:
            yield from block.written()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def settled(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the sums over their pairs."""
    order = np.argsort(right["place"].to_numpy())
    total, best = right["total"].to_numpy()[order], right["best"].to_numpy()[order].astype(bool)
    kind = np.min_scalar_type(max(len(order), 1))
    sums, bests = [], []
    for places, times in zip(left["places"].to_pylist(), left["times"].to_pylist()):
        at = np.frombuffer(places, kind)
        often = np.frombuffer(times, f"u{len(times) // len(at)}").astype(np.int64) if len(at) else np.zeros(0, np.int64)
        sums.append(int((often * total[at]).sum()))
        bests.append(int(often[best[at]].sum()))
    done = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.table([done[c] if c in done else left[c] for c in names], names=names)


def pair_totals(held: DataFrame) -> DataFrame:
    """(pair, total, best): how many links hold the pair, and whether no other A id is linked with its B id more often."""
    b = F.col("pair").bitwiseAND((1 << BITS) - 1)
    totals = held.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", b)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, digest: bool = False, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): aligned tokens of every document.

    ``groups`` reads a1,a2|b1;a3|b2,b3 with the ids of A and B in order, or is its SHA-256 (``digest``). ``n_best`` counts the links whose
    pair is its B id's most frequent of all documents, ``count_sum`` adds up the links' pair counts.
    """
    stored = durable(blocks_of(docs, digest, byte_level, pieces), "aligned")
    zipped = F.posexplode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("totals").alias("n")))
    held = stored.where("pairs IS NOT NULL").select("block", zipped.alias("place", "cell")).select("block", "place", "cell.pair", "cell.n")
    found = held.join(pair_totals(held), "pair").select(F.col("block").alias("of"), "place", "total", "best")
    documents = stored.where("pairs IS NULL").select(*COLUMNS[:9])
    return documents.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(settled, OUT)


def linked_pairs(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(a_id, b_id, n_links, best): all linked id pairs of the corpus, the table that maps one vocabulary to the other."""
    stored = durable(blocks_of(docs, True, byte_level, pieces), "aligned")
    cells = F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("totals").alias("n")))
    totals = pair_totals(stored.where("pairs IS NOT NULL").select(cells.alias("cell")).select("cell.pair", "cell.n"))
    return totals.select(
        F.shiftright("pair", BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << BITS) - 1).alias("b_id"), F.col("total").alias("n_links"), "best"
    )
