"""Codec, decontamination, fingerprints, passages and toxicity against plain versions, with defined cases."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from llm import plain
from pyspark.sql import functions as F

from ratesift.llm.decontamination import contaminated, weighted_likeness
from ratesift.llm.passage_dedup import repeated_passages
from ratesift.llm.piecewise_hash import Fingerprinter, common_length, fingerprints, likeness
from ratesift.llm.sentencepiece_codec import MARK, MODEL, StreamingEncoder, Vocabulary, encode_documents
from ratesift.llm.toxicity import KINDS, _packed, toxicity


def sentence(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


ODD = ["", "  a  b ", "é x　ﬁ\t\n\n  ab\r\n", "<s> a</s>", "▁x", "\x00a", "a<0x41>", "a" * 3000, " " * 77, "日本語テキスト" * 20, "😀😀 x😀"]


def odd_texts(rng):
    return ODD + ["".join(rng.choice("aetn  ▁.,é😀日\n'") for _ in range(rng.randrange(80))) for _ in range(300)]


def test_codec_equals_the_public_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts(random.Random(1)) + [None]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    found = {r.doc_id: r for r in encode_documents(docs).collect()}
    for i, text in enumerate(texts):
        assert list(found[i].ids) == model.encode(text or "")
        assert found[i].decoded == (text or "").replace(MARK, " ") == model.decode(list(found[i].ids)) and found[i].round_trip
    assert encode_documents(docs.where("doc_id < 0")).count() == 0


def test_stream_keeps_a_bounded_window():
    sentencepiece = pytest.importorskip("sentencepiece")
    model, vocabulary, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), Vocabulary(), random.Random(2)
    for text in [t for t in odd_texts(rng) if t] + ["thorreouoningedherinen" * 40]:
        stream, out, marked, most = StreamingEncoder(vocabulary), [], MARK + text.replace(" ", MARK), 0
        while marked:
            n = rng.randrange(1, 9)
            out += stream.feed(marked[:n])
            marked, most = marked[n:], max(most, len(stream.tokens))
        assert out + stream.close() == model.encode(text)
        assert most <= 8 * vocabulary.longest


def test_leaks_against_all_windows(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, n)) for i, n in enumerate([3, 5, 6, 15, 16, 22, 31, 45, 60, 140, 300])] + [(50, None), (51, "")]
    docs = []
    for _, text in items * 2:
        own = (text or "").split()
        for edits in (0, 1, 2):
            changed = list(own)
            for _ in range(edits if own else 0):
                changed[rng.randrange(len(changed))] = "zz"
            docs.append((len(docs), " ".join([sentence(rng, rng.randrange(90)), *changed, sentence(rng, rng.randrange(90))])))
    docs += [(900, items[6][1]), (901, " ".join(items[7][1].split()[:40])), (902, None), (903, ""), (902, items[5][1].upper())]
    wanted = {i: Counter(zip(*(plain.words(t)[k:] for k in range(5)))) for i, t in items}
    expected = {}
    for d, text in docs:
        own = plain.words(text)
        grams = list(zip(*(own[k:] for k in range(5))))
        for i, w in wanted.items():
            n = len(plain.words(dict(items)[i])) - 4
            best = max((weighted_likeness(Counter(grams[s: s + n]), w) for s in range(len(grams))), default=0) if w else 0
            if best >= 0.8:
                expected[d, i] = round(max(best, expected.get((d, i), 0)), 9)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(*frames).collect()}
    assert found == expected and len(found) > 20
    assert contaminated(frames[0], frames[1].where("item_id < 0")).count() == contaminated(frames[0].where("doc_id < 0"), frames[1]).count() == 0


def test_leaks_shorter_than_their_item(spark):
    rng = random.Random(15)
    items = [(i, sentence(rng, n, 30_000)) for i, n in enumerate([95] * 40 + [100] * 41)]
    docs = [(100 * i + n, " ".join(text.split()[:n])) for i, text in items[:40] for n in (75, 77, 78, 79, 80)]
    found = contaminated(
        spark.createDataFrame([(*d, i) for d, i in zip(docs, range(len(docs)))], "doc_id long, text string, item_id long"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d // 100) for d, _ in docs if d % 100 >= 77}


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(6)
    texts = [sentence(rng, rng.randrange(400)) for _ in range(60)] + ["", None, "ä", "日本" * 300, "ab" * 20_000]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(9, "repeated id"), (9, "repeated id"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints(docs).collect()
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    make, expected = Fingerprinter(), []
    for (d, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [make(x.encode()) for x in (text, edited, after)]
        expected.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1],
                         likeness(prints[0], prints[1]), likeness(prints[0], prints[2])))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    long = [r for r in found if r.n_chars > 300 and r.n_chars < 5000]
    assert sorted(r.near_edited for r in long)[len(long) // 10] > 0.3 and sorted(r.near_next for r in long)[-len(long) // 10] < 0.2
    only = fingerprints(docs.where("doc_id = 3")).collect()
    assert len(only) == 1 and only[0].near_next == 1.0 and fingerprints(docs.where("doc_id = -1")).count() == 0


def test_fingerprint_is_local_and_common_length_exact():
    rng, make = random.Random(7), Fingerprinter()
    text = sentence(rng, 900).encode()
    assert likeness(make(text), make(text[:2000] + b"new words here" + text[2000:])) > 0.85
    assert make(b"") == make(b"") and likeness(make(b""), make(b"")) == 1.0
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 20))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
        assert common_length(a, b) == row[-1]


def test_repeated_passages_against_all_windows(spark):
    rng = random.Random(8)
    passages = [sentence(rng, n).split() for n in (51, 52, 60, 75, 120)]
    short = sentence(rng, 30).split()
    rows = []
    for i in range(160):
        own = sentence(rng, rng.randrange(0, 200)).split()
        at = rng.randrange(len(own) + 1)
        middle = passages[i % 5] if i % 3 == 0 else short if i % 3 == 1 else []
        rows.append((i, " ".join(own[:at] + middle + own[at:])))
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, None), (301, ""), (302, "a b"), (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int")
    found = repeated_passages(docs).collect()
    windows = {}
    for d, text in rows:
        own = plain.words(text)
        for k in range(len(own) - 49):
            windows.setdefault(tuple(own[k: k + 50]), set()).add(d)
    expected = {d for held in windows.values() if len(held - {None}) > 1 for d in held} - {None}
    assert {r.doc_id for r in found} == expected
    for passage in {r.passage_id for r in found}:
        group = [r for r in found if r.passage_id == passage]
        assert sum(not r.removed for r in group) == 1 and all(r.kept_doc_id == min(x.doc_id for x in group) for r in group)
    assert repeated_passages(docs.where("doc_id < 0")).count() == 0


def test_toxicity_learns_stems_and_leaves_held_out_rows_alone(spark):
    rng = random.Random(9)
    bad, rows, labels = ["grumbex", "grumbel", "grumbo", "vexnar"], [], []
    for i in range(900):
        own, toxic = sentence(rng, rng.randrange(5, 60), 400).split(), i % 5 == 0
        if toxic:
            own.insert(rng.randrange(len(own)), rng.choice(bad) + rng.choice("aeiou") + ",")
        rows.append((i, " ".join(own), "en" if i % 2 else None))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "en"), (5001, "", None), (None, "text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity(docs, known).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(found) == len(rows) and {i for i, r in found.items() if r.held_out and i in dict(labels)} == set(held)
    right = sum(found[i].predicted == dict(labels)[i] for i in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in found.values())
    unlabelled = toxicity(docs, known.where("toxic = 0")).collect()
    assert {r.score for r in unlabelled} == {0.0} and not any(r.rejected for r in unlabelled)
    wrong = known.replace({0: 1, 1: 0}, subset=["toxic"]).where(f"doc_id IN ({','.join(map(str, held))})")
    flipped = known.where(f"doc_id NOT IN ({','.join(map(str, held))})").unionByName(wrong)
    assert {r.doc_id: r.score for r in toxicity(docs, flipped).collect()} == {i: r.score for i, r in found.items()}
    assert toxicity(docs.where("doc_id < 0"), known).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A stem of rows that a draw of 4000 rows by hash leaves out is learned too, from several shards."""
    monkeypatch.setattr("ratesift.llm.toxicity.SHARD_ROWS", 1500, raising=False)
    rng = random.Random(4)
    ids = spark.range(7000).selectExpr(
        "id", "pmod(xxhash64('draw', id), 1000000) / 1000000 AS draw", "crc32(CAST(id AS STRING)) % 4 = 2 AS held_out"
    ).collect()
    rows, labels, rare = [], [], []
    for r in ids:
        own, toxic = sentence(rng, rng.randrange(4, 9), 300).split(), r.id >= 700
        if toxic:
            left_out = r.draw > 0.9 and r.id % 4 == 0
            own.insert(rng.randrange(len(own)), "vexnarol" if left_out else "grumbexa")
            rare += [r.id] * (left_out and r.held_out)
        rows.append((r.id, " ".join(own), "en"))
        labels.append((r.id, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.score for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    clean = [found[r.id] for r in ids if r.held_out and r.id < 700]
    assert len(rare) > 20 and min(found[i] for i in rare) > 0.5 and sum(s < 0.5 for s in clean) >= 0.95 * len(clean)


def test_toxicity_shards_hold_a_row_for_each_document(spark):
    """A shard is one partition's run of small rows in order, so that no row grows with it."""
    rows = [(i, " ".join(["w"] * (i + 1)), "en", i % 2, i % 4 == 0) for i in range(300)]
    packed = _packed(spark.createDataFrame(rows, "label_id long, text string, lang string, toxic int, held boolean").repartition(3), 4)
    found = packed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).collect()
    assert len(found) == 300 and {r.shard for r in found} == set(range(4)) and len({(r.shard, r.part) for r in found}) == 4
    for shard in range(4):
        sizes = [len(r.ids) for r in sorted(found, key=lambda r: r["at"]) if r.shard == shard]
        assert sizes == sorted(sizes)
    assert sorted(len(r.ids) for r in found) == [2 * KINDS * (i + 1) for i in range(300)]
