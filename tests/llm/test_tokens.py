"""Packing, token alignment and segments against whole-text tokenization, with defined cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ratesift.llm import token_alignment
from ratesift.llm.packing import TOKENIZER, Bins, TextIds, lengths_of, pack
from ratesift.llm.queries import QUERIES
from ratesift.llm.segments import parts_of, slices, text_of
from ratesift.llm.token_alignment import BYTE_LEVEL, PIECES, align_tokens, linked_pairs

SF = "/root/testdata/sf0.001"
BITS = ["a", "b", "foo", "'s", " ", "  ", "\n", "\t", ".", ",,", "é", "日本", "😀", "<|endoftext|>", "1", "²", "_", "\x1c",
        "\x85", "don't", "\r\n", "́", "▁", "𐍈", "\x00", "<0x41>", "</s>"]
ODD = [None, "", " ", "\n", "  a  b ", "é x　ﬁ\t\n\n  ab\r\n", "a" * 3000, " " * 77, "日本語テキスト" * 20, "x.\n\n\n.y", "foo\t bar", "foo\t"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_level():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(TOKENIZER)


def numbers(data):
    return np.frombuffer(bytes(data), "<u4").tolist()


def test_ids_of_segments_are_those_of_the_text(byte_level):
    texts = [t or "" for t in odd_texts(1, 6000)]
    with open(TOKENIZER, encoding="utf-8") as file:
        encode = TextIds(file.read())
    found = [numbers(ids) for i in range(0, len(texts), 200) for ids in encode(texts[i: i + 200])]
    assert found == [e.ids for e in byte_level.encode_batch(texts, add_special_tokens=False)]
    encode.kept.limit = 50  # generations that change all the time
    found = [numbers(ids) for i in range(0, len(texts), 50) for ids in encode(texts[i: i + 50])]
    assert found == [e.ids for e in byte_level.encode_batch(texts, add_special_tokens=False)]


def test_equal_parts_of_many_texts_are_looked_up_once(byte_level):
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    with open(TOKENIZER, encoding="utf-8") as file:
        encode = TextIds(file.read())
    encode.kept.young = Counted(encode.kept.young)
    texts = ["the cat sat on the mat\nand the cat ran"] * 500 + [t or "" for t in odd_texts(7, 500)]
    assert encode(texts[:500]) == encode(texts[:1]) * 500 and Counted.asked < 100
    found = encode(texts)
    assert [numbers(ids) for ids in found] == [byte_level.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_and_parts_give_the_text_back():
    for text in odd_texts(2, 500):
        assert "".join(slices(text or "", 5)) == (text or "")
        assert "".join(map(text_of, parts_of(" " + (text or "")))) == " " + (text or "")
    long = "word\nother " * 300_000
    cut = list(slices(long))
    assert len(cut) == 4 and "".join(cut) == long and all(c[0] in " \n" for c in cut[1:])


def test_lengths_fill_their_bins():
    for capacity in (16, 100, 2048):
        for n in range(1, 3 * capacity):
            lengths = lengths_of(n, capacity)
            assert sum(lengths) == n and min(lengths) > 0 and max(lengths) <= capacity
            assert len(lengths) <= n // capacity + 4
            assert all(16 * (capacity - capacity // x * x) <= capacity or capacity - capacity // x * x <= capacity // x for x in lengths)


def test_bins_hold_a_fixed_number_each():
    bins, rng = Bins(100), random.Random(3)
    placed = [x for i in range(5000) for x in bins.add((i, 0, rng.choice([100, 50, 49, 33, 7])))]
    sequences = {}
    for piece, number, offset in placed:
        sequences.setdefault(number, []).append((offset, piece[2]))
    for held in sequences.values():
        assert len({100 // n for _, n in held}) == 1 and len(held) == 100 // held[0][1]
    rest = list(bins.close())
    assert len(placed) + len(rest) == 5000 and len({n for _, n, _ in rest}) <= 4 and not bins.open


def checked(rows, want, capacity):
    """Pieces cover each document once, sequences have no gaps; returns the share of padding."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert documents.keys() == want.keys()
    for doc_id, ids in want.items():
        pieces = sorted(documents[doc_id], key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        for r in pieces:
            crc = zlib.crc32(np.array(ids[r["start"]: r["start"] + r["length"]], "<u4").tobytes())
            assert crc == (r["ids_crc32"] if "ids_crc32" in r else zlib.crc32(bytes(r["ids"])))
    used = padding = 0
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        used, padding = used + end, padding + (capacity - end if end & (end - 1) else 0)
    return padding / (used + padding)


def test_packed_documents(spark, byte_level):
    query = [r.asDict() for r in QUERIES["op13_harmonic_packing"](spark, SF).collect()]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: [*byte_level.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert checked(query, want, 2048) < 0.02


def test_packing_cases(spark, byte_level):
    texts = dict(enumerate(odd_texts(4, 300))) | {9000: "ab cd " * 200_000}
    docs = spark.createDataFrame([(i, t, [1], 5) for i, t in texts.items()], "doc_id long, text string, ids array<int>, length int")
    want = {i: [*byte_level.encode(t or "", add_special_tokens=False).ids, 7] for i, t in texts.items()}
    for partitions in (1, 7):
        rows = [r.asDict() for r in pack(docs.repartition(partitions), capacity=64, end_id=7).collect()]
        assert checked(rows, want, 64) < 0.02
    assert pack(docs.where("doc_id < 0")).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    rows = pack(same, capacity=64).collect()
    assert sorted((r.doc_id is None, r.length, r.doc_tokens) for r in rows) == [(False, 1, 1), (True, 3, 3), (True, 3, 3)]


def plain_alignment(texts):
    """Tokens with byte ends, groups and links of whole texts, by definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    names |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if chr(c) not in names)}
    out, pairs = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a_ids = a.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = b.encode(text or "")
        a_bytes = [bytes(names[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((0, 0, 0, [], ""))
            continue
        ends = []
        for parts in (a_bytes, b_bytes):
            ends.append(np.cumsum([len(p) for p in parts]).tolist())
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, a_ids[i:x])) + "|" + ",".join(map(str, b_ids[j:y])))
            i, j = x, y
        links = [(a_ids[i], b_ids[j]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1])
                 if max(e - len(a_bytes[i]), f - len(b_bytes[j])) < min(e, f)]
        pairs.update(links)
        out.append((len(a_ids), len(b_ids), len(cuts), links, ";".join(groups)))
    highest = {}
    for (_, y), n in pairs.items():
        highest[y] = max(highest.get(y, 0), n)
    return [(n_a, n_b, g, len(links), sum(pairs[p] == highest[p[1]] for p in links), sum(pairs[p] for p in links), groups)
            for n_a, n_b, g, links, groups in out], pairs, highest


def test_alignment_equals_the_definition(spark, monkeypatch):
    pytest.importorskip("sentencepiece")
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 2000)  # many blocks
    texts = odd_texts(5, 1200) + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect() if len(r.text) < 4000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    want, pairs, highest = plain_alignment(texts)
    found = {r.doc_id: tuple(r)[1:] for r in align_tokens(docs).collect()}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert align_tokens(docs).columns == ["doc_id", *names]
    wrong = [(texts[i], found[i], want[i]) for i in range(len(texts)) if found[i] != want[i]]
    assert not wrong, wrong[:2]
    table = {(r.a_id, r.b_id): (r.n_links, r.best) for r in linked_pairs(docs).collect()}
    assert table == {p: (n, n == highest[p[1]]) for p, n in pairs.items()}


def test_alignment_query_and_cases(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    shortest = sorted((i for i in texts if texts[i]), key=lambda i: len(texts[i]))[:30]
    for i, w in zip(shortest, plain_alignment([texts[i] for i in shortest])[0]):
        assert (rows[i].n_a, rows[i].n_b, rows[i].n_groups, rows[i].n_links) == w[:4]
        assert rows[i].groups_sha256 == hashlib.sha256(w[6].encode()).hexdigest()
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (4, ""), (5, "x▁y"), (6, "x y " * 700_000)], "doc_id long, text string")
    found = align_tokens(odd, digest=True).collect()
    assert sorted(r.n_a for r in found if r.doc_id is None) == [2, 2]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in found if r.doc_id in (3, 4, 5))
    assert [r.n_a > 1_400_000 - 2 for r in found if r.doc_id == 6] == [True]
    assert align_tokens(odd.where("doc_id < 0")).count() == 0
