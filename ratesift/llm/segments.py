"""Cuts of texts at places over which no token reaches, so that every distinct segment is tokenized only now and then.

A byte-level tokenizer splits a text into words before it merges. A blank or line feed between two characters that are
no blanks always starts such a word, and so does ASCII punctuation after a letter or digit. A text is cut there; ids of
the text are the ids of its segments one after the other. Segments are encoded many at a time, as one text again, and
kept by process in two generations of bounded size: what drops out costs time only.

A led text (one that begins with a blank or line feed) is a list of parts: "\nword" keeps its line feed, "word" stands
for a blank and the word. Where blanks meet, parts are joined to one segment, told by two blanks ahead of its text.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ratesift.llm.sentencepiece_codec import kept_by_process

#: Code points of a text that are cut and looked up at once.
SLICE_CHARS = 1 << 20
#: Segments encoded as one text.
JOINED = 2000
JOINT = "  "
CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """A long text in slices of about ``size`` that all but the first begin with their blank or line feed."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at: cut.start()]
        at = cut.start()
    yield text[at:]


def parts_of(led: str) -> list[str]:
    """Parts of a text that begins with a blank or line feed."""
    return led.replace("\n", " \n").split(" ")[1:]


def text_of(part: str) -> str:
    if part.startswith(JOINT):
        return part[len(JOINT):]
    return part if part.startswith("\n") else " " + part


def unclean(part: str) -> bool:
    """Whether the part's place may be no cut or the next one's may be none: blanks meet there, or the text ends in one."""
    body = part[1:] if part.startswith("\n") else part
    return not body or body[0].isspace() or body[-1].isspace()


def joined_parts(parts: list[str]) -> list[str]:
    """The parts with those united between which there is no cut."""
    out: list[str] = []
    held, whole = text_of(parts[0]), not unclean(parts[0])
    last = parts[0]
    for part in parts[1:]:
        text = text_of(part)
        if not held[-1].isspace() and len(text) > 1 and not text[1].isspace():
            out.append(last if whole else JOINT + held)
            held, whole = text, not unclean(part)
        else:
            held, whole = held + text, False
        last = part
    out.append(last if whole else JOINT + held)
    return out


class Kept:
    """Values of segments in two generations of ``limit`` entries at most, and how to find those of new ones."""

    def __init__(self, key: str, find: Callable[[list[str]], list], marks: str, add: Callable, whole: tuple[str, ...], limit: int):
        """``find`` gives the values of segments, ``add`` that of a word and the line behind it; ``whole`` strings aren't cut."""
        self.store = kept_by_process(key)
        self.find, self.marks, self.add, self.limit = find, marks, add, limit
        self.whole = re.compile("|".join(map(re.escape, whole))).search if whole else None
        self.young: dict = self.store.setdefault("young", {})

    def _learn(self, parts: Iterable[str]) -> None:
        """Put the values of parts that aren't young among the young; punctuation behind a word counts as a line of its own."""
        old, young, marks, whole = self.store.get("old", {}).get, self.young, self.marks, self.whole
        cuts, new = [], {}
        for part in parts:
            if (value := old(part)) is not None:
                young[part] = value
                continue
            core = part.rstrip(marks)
            if core == part or not core or not core[-1].isalnum() or part[0] == " " or whole and whole(part):
                new[part] = None
                continue
            tail = "\n" + part[len(core):]
            cuts.append((part, core, tail))
            for piece in (core, tail):
                if piece not in young:
                    if (value := old(piece)) is not None:
                        young[piece] = value
                    else:
                        new[piece] = None
        segments = [p for p in new if not p[-1:].isspace()]
        groups = [segments[i: i + JOINED] for i in range(0, len(segments), JOINED)]
        for some in (*groups, *([p] for p in new if p[-1:].isspace())):  # a blank at the end would meet the next one's
            young.update(zip(some, self.find([text_of(p) for p in some])))
        add = self.add
        for part, core, tail in cuts:
            young[part] = add(young[core], young[tail])

    def _age(self) -> None:
        if len(self.young) > self.limit:
            self.store["old"], self.store["young"] = self.young, {}
            self.young = self.store["young"]

    def joined(self, led: list[str]) -> list[bytes]:
        """For every led text the values of its segments, which are 32-bit numbers as bytes, one after the other.

        Parts that are equal in any of the texts are looked up once.
        """
        self._age()
        lists = pc.split_pattern(pc.replace_substring(pa.array(led, pa.large_string()), "\n", " \n"), " ")
        ends = np.asarray(lists.value_lengths()).cumsum()
        begin = np.ones(len(lists.values), bool)
        begin[np.append(0, ends[:-1])[: len(ends)]] = False  # ahead of a text's first blank is no part
        coded = lists.values.dictionary_encode()
        code, parts = coded.indices.to_numpy()[begin], coded.dictionary.to_pylist()
        bounds = np.append(0, ends - np.arange(1, len(ends) + 1))
        found = list(map(self.young.get, parts))
        missing = [i for i, value in enumerate(found) if value is None]
        unfit = np.zeros(len(parts), bool)
        unfit[[i for i in missing if unclean(parts[i])]] = True
        self._learn([parts[i] for i in missing if not unfit[i]])
        for i in missing:
            found[i] = b"" if unfit[i] else self.young[parts[i]]
        numbers = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        size, start = sizes[code], (np.cumsum(sizes) - sizes)[code]
        upto = np.append(0, np.cumsum(size))
        data = numbers[np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)].tobytes()
        at = (4 * upto[bounds]).tolist()
        out = [data[a:b] for a, b in zip(at, at[1:])]
        apart = np.unique(np.searchsorted(bounds, np.flatnonzero(unfit[code]), "right") - 1).tolist()
        for i, values in zip(apart, self.values([led[i] for i in apart])):
            out[i] = b"".join(values)
        return out

    def values(self, led: list[str]) -> list[list]:
        """For every led text the values of its segments."""
        self._age()
        young = self.young
        get = young.get
        texts = [parts_of(t) for t in led]
        found = [list(map(get, parts)) for parts in texts]
        open_ = [i for i, values in enumerate(found) if None in values]
        missing = {p for i in open_ for p, v in zip(texts[i], found[i]) if v is None}
        if gone := set(filter(unclean, missing)):
            missing -= gone
            for i in open_:
                if not gone.isdisjoint(texts[i]):
                    texts[i] = joined_parts(texts[i])
                    found[i] = list(map(get, texts[i]))
                    missing.update(p for p, v in zip(texts[i], found[i]) if v is None)
        self._learn(missing)
        for i in open_:
            found[i] = [young[p] if v is None else v for p, v in zip(texts[i], found[i])]
        return found


class ByteLevel:
    """A byte-level tokenizer and what its tokens spell."""

    def __init__(self, serialized: str, plain: bool):
        """``plain``: strings of special tokens are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialized)
        self.tokenizer.encode_special_tokens = plain
        spec = json.loads(serialized)
        pre = spec["pre_tokenizer"] or {}
        added = [t for t in spec["added_tokens"] if not (plain and t["special"])]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("not a byte-level tokenizer that splits words by the common pattern")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("an added token reaches over blanks")
        self.whole = tuple(t["content"] for t in added)
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for 256 and on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.spelled = [special.get(i) or bytes(map(byte_of.__getitem__, self.tokenizer.id_to_token(i) or "")) for i in range(size)]
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def fast_ids(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, as little-endian unsigned 32-bit numbers; the segments are encoded as one text."""
        encoded = self.tokenizer.encode_batch_fast(["".join(segments)], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, "<u4")
        ends = np.cumsum([len(s.encode()) for s in segments])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right")
        data, at, out = ids.tobytes(), 0, []
        for cut in (cuts * 4).tolist():
            out.append(data[at:cut])
            at = cut
        return out


#: ASCII punctuation: after a letter or digit, it starts a word of its own.
MARKS = string.punctuation
