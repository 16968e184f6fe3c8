"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is a byte-pair model. A token sequence is that model's encoding exactly if every two neighbours are: if
merging the characters of two tokens by themselves gives those two tokens back. So the search keeps, for each of the
last positions (as many as the longest piece has characters), the one token that may end there: the piece that ends
there and whose neighbour before it is compatible. An automaton of all pieces names those that end at a character,
longest first. Backpointers are kept from the last committed boundary on; whenever those of all positions in the window
meet in one boundary, the ids up to it are final and leave memory.

All paths meet wherever no piece holds the two characters around a place side by side. For blanks' marks, punctuation
after letters and line ends that is read off the vocabulary on loading; the spans between such places are looked up
among those encoded before. Of the encoded spans, those not met again drop out in time, which costs time only.

Characters outside the vocabulary become byte tokens. Decoding turns blanks' marks into blanks, joins bytes and drops
the blank that encoding puts first; broken bytes become U+FFFD.

Defined cases: a null or empty text has no ids; a literal mark U+2581 decodes as a blank, as the model has it; repeated
rows are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
import sys
from array import array
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A vocabulary travels with the tasks; a larger one is refused.
MAX_PIECES = 1_000_000
LONGEST_KNOWN, MOST_KNOWN, MOST_PAIRS = 48, 120_000, 400_000
#: Words between blanks that a process keeps, twice over.
MOST_PARTS = 100_000
OUT = "doc_id long, n_chars long, n_ids long, ids array<int>, decoded string, round_trip boolean"


def kept_by_process(key: str) -> dict:
    """A table that outlives a task where Spark reuses the Python worker for the next one."""
    holder = sys.modules.setdefault("ratesift_kept_by_process", ModuleType("ratesift_kept_by_process"))
    return holder.__dict__.setdefault(key, {})


class Vocabulary:
    """Pieces, ranks and byte tokens of a byte-pair SentencePiece model."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.vocab_size() > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
            self.pieces.append("" if model.is_control(i) else piece)
        self.name = hashlib.sha256("\n".join(f"{p} {s}" for p, s in self.scores.items()).encode()).hexdigest()
        self.longest = max(map(len, self.ids))
        pairs = {pair for p in self.ids for pair in zip(p, p[1:])}
        bound = {x for x, y in pairs if x.isalnum() and y in string.punctuation}  # letters that join with a sign
        lone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in self.ids))
        marks = re.escape(string.punctuation)
        ends = any(x != MARK and y == MARK for x, y in pairs)
        words = f"{MARK}*[^\\W_{re.escape(''.join(sorted(bound)))}]+(?=[{MARK}{marks}{lone}]|$)|{MARK}*[^{MARK}{lone}]+|{MARK}+"
        self.spans = None if ends else re.compile(f"{words}|[{lone}]" if lone else words)

    def automaton(self):
        """Finds the pieces that end at each character, longest first; built once a process."""
        import ahocorasick

        kept = kept_by_process(f"automaton of {self.name}")
        if not kept:
            found = ahocorasick.Automaton()
            for piece in self.ids:
                found.add_word(piece, piece)
            found.make_automaton()
            kept["pieces"] = found
        return kept["pieces"]

    def merged(self, text: str) -> list[str]:
        """A short text's tokens by merging: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]


class StreamingEncoder:
    """Feed marked text in pieces of any size; ids come out as they become final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.endings = vocabulary, vocabulary.automaton()
        #: Whether two tokens may be neighbours, by process.
        self.compatible: dict[str, dict[str, bool]] = kept_by_process(f"pairs of {vocabulary.name}")
        self.known_pairs = sum(map(len, self.compatible.values()))
        self._restart()

    def _restart(self) -> None:
        self.anchor = ""  # the last committed token
        self.text = ""  # from the last committed boundary on
        self.tokens: list[str | None] = []  # by position: the token that ends there
        self.at = 0  # the first position without a token

    def _fits(self, left: str, right: str) -> bool:
        if self.known_pairs >= MOST_PAIRS:
            self.compatible.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        good = self.v.merged(left + right) == ([left, right] if left else [right])
        self.compatible.setdefault(left, {})[right] = good
        return good

    def _search(self) -> None:
        """Find the token that ends at each new position."""
        text, tokens, compatible, at = self.text, self.tokens, self.compatible, self.at
        for end, piece in self.endings.iter(text, max(0, at - self.v.longest + 1)):
            if tokens[end] is not None or end < at:
                continue
            last = end - len(piece)
            if last >= 0:
                left = tokens[last]
                if left is None:  # no piece ends there: a character outside the vocabulary
                    left = tokens[last] = text[last]
            elif last == -1:
                left = self.anchor
            fits = compatible.get(left)
            good = fits.get(piece) if fits is not None else None
            if good or good is None and self._fits(left, piece):
                tokens[end] = piece
        if None in tokens:
            self.tokens = [c if t is None else t for t, c in zip(tokens, text)]
        self.at = len(text)

    def feed(self, text: str) -> list[int]:
        self.text += text
        self.tokens += [None] * len(text)
        self._search()
        return self._take(self._meeting()) if self.at >= 2 * self.v.longest else []

    def _meeting(self) -> int:
        """The boundary in which the paths of all positions meet from which a later token may start."""
        ends = set(range(max(0, self.at - self.v.longest + 1), self.at + 1))
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - len(self.tokens[last - 1]))
        return ends.pop()

    def _take(self, boundary: int) -> list[int]:
        path, at = [], boundary
        while at > 0:
            path.append(self.tokens[at - 1])
            at -= len(path[-1])
        if path:
            self.anchor = path[0]
        self.text, self.tokens, self.at = self.text[boundary:], self.tokens[boundary:], self.at - boundary
        out: list[int] = []
        for piece in reversed(path):
            known = self.v.ids.get(piece)
            out += [known] if known is not None else [self.v.byte_ids[b] for b in piece.encode()]
        return out

    def close(self) -> list[int]:
        out = self._take(len(self.text))
        self._restart()
        return out

    def whole(self, text: str) -> list[int]:
        """All ids of a short text."""
        self.text, self.tokens = text, [None] * len(text)
        self._search()
        return self.close()


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.encoder = vocabulary, StreamingEncoder(vocabulary)
        self.kept = kept_by_process(f"spans of {vocabulary.name}")
        self.known: dict[str, tuple[bytes, str]] = self.kept.setdefault("young", {})
        self.parts: dict[str, tuple[bytes, str]] = self.kept.setdefault("parts", {})
        self.spelled = [p.replace(MARK, " ") for p in vocabulary.pieces]

    def _long(self, span: str) -> bytes:
        """Ids of a span of any length, fed in slices: only the last ones and the ids already final are held."""
        ids, size = array("i"), 4 * self.v.longest
        for at in range(0, len(span), size):
            ids.extend(self.encoder.feed(span[at: at + size]))
        ids.extend(self.encoder.close())
        return ids.tobytes()

    def _span(self, span: str) -> tuple[bytes, str]:
        """(ids, the text that they decode to) of a span; a character's bytes are never in two spans."""
        if len(span) > LONGEST_KNOWN:
            ids = self._long(span)
            return ids, self._spell(np.frombuffer(ids, np.int32).tolist())
        both = self.kept.get("old", {}).get(span)
        if both is None:
            ids = array("i", self.encoder.whole(span))
            both = ids.tobytes(), self._spell(ids)
        if len(self.known) >= MOST_KNOWN:
            self.kept["old"], self.kept["young"] = self.known, {}
            self.known = self.kept["young"]
        self.known[span] = both
        return both

    def _part(self, part: str) -> tuple[bytes, str]:
        """(ids, what they decode to) of the blank's mark and a word."""
        both = self.kept.get("old parts", {}).get(part)
        if both is None:
            found = self._spans(MARK + part)
            both = found[0] if len(found) == 1 else (b"".join([i for i, _ in found]), "".join([t for _, t in found]))
        if len(part) <= LONGEST_KNOWN:
            self.parts[part] = both
        return both

    def _spans(self, marked: str) -> list[tuple[bytes, str]]:
        return [self.known.get(span) or self._span(span) for span in (self.v.spans.findall(marked) if self.v.spans else [marked])]

    def both(self, text: str) -> tuple[np.ndarray, str]:
        """(ids, what they decode to): known words bring both with them."""
        if len(self.parts) > MOST_PARTS:
            self.kept["old parts"], self.kept["parts"] = self.parts, {}
            self.parts = self.kept["parts"]
        parts = text.split(" ") if text else []
        found = list(map(self.parts.get, parts))
        if None in found:
            if not self.v.spans or "" in parts or MARK in text:  # marks side by side may be one piece
                found = self._spans(MARK + text.replace(" ", MARK))
            else:
                found = [self._part(p) if f is None else f for p, f in zip(parts, found)]
        return np.frombuffer(b"".join([ids for ids, _ in found]), np.int32), "".join([spelled for _, spelled in found])[1:]

    def encode(self, text: str) -> np.ndarray:
        return self.both(text)[0]

    def _spell(self, ids: Iterable[int]) -> str:
        byte_of, parts, held = self.v.byte_of, [], bytearray()
        if byte_of.keys().isdisjoint(ids):
            return "".join([self.spelled[i] for i in ids])
        for i in ids:
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                parts.append(held.decode(errors="replace"))
                held.clear()
            parts.append(self.spelled[i])
        if held:
            parts.append(held.decode(errors="replace"))
        return "".join(parts)

    def decode(self, ids: Iterable[int]) -> str:
        text = self._spell(ids)
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids, decoded, round_trip): the ids of every text, and the text decoded from them again."""
    vocabulary = Vocabulary(model)  # bounded by MAX_PIECES

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part["text"].to_pylist()]
                encoded, decoded = zip(*[codec.both(t) for t in texts])
                offsets = np.zeros(len(texts) + 1, np.int32)
                np.cumsum([len(e) for e in encoded], out=offsets[1:])
                flat = np.concatenate(encoded)
                yield pa.record_batch([
                    part["doc_id"].cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(decoded, pa.string()), pa.array([d == t.replace(MARK, " ") for d, t in zip(decoded, texts)], pa.bool_()),
                ], names=["doc_id", "n_chars", "n_ids", "ids", "decoded", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, OUT)
