"""Periodic runs against a search of all periods, with defined cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from llm import plain

from ratesift.llm.periodic_runs import kept_words, least_level, periodic_runs, repeating, runs_of, suffixes
from ratesift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def all_runs(words, min_length, min_periods):
    """Every period from place to place; (start, length, period)."""
    out, n = [], len(words)
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(min_length, min_periods * q):
                part = words[s: s + length]
                if all(part[p:] != part[: length - p] for p in range(1, q)):
                    out.append((s, length, q))
            i += 1
    return sorted(out)


def stretches(rng):
    """Words with runs, nested and side by side."""
    out = []
    for _ in range(rng.randint(0, 6)):
        root = [rng.randint(0, 2) for _ in range(rng.randint(1, 12))]
        out += (root * rng.randint(1, 9))[: rng.randint(1, 70)]
        out += [rng.randint(0, 5)] * rng.randint(0, 1)
    return out


def test_runs_equal_a_search_of_all_periods():
    rng, met = random.Random(1), 0
    for _ in range(1500):
        words = stretches(rng) if rng.random() < 0.7 else [rng.randint(0, 1) for _ in range(rng.randint(0, 90))]
        least = rng.choice([(24, 3), (6, 2), (8, 3), (2, 2), (10, 4)])
        want = all_runs(words, *least)
        assert runs_of(np.array(words, np.int64), *least) == want, (words, least)
        met += len(want)
        if want:  # the filter loses no text
            assert repeating([[b"z"] * 3, [b"%d" % w for w in words]], least_level(*least))[-1:] == [1]
    assert met > 3000 and least_level(24, 3) == 16


def test_suffixes_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
        order, common = suffixes(np.array(words))
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        for x, y, n in zip(order, order[1:], common):
            assert words[x: x + n] == words[y: y + n] and words[x + n: x + n + 1] != words[y + n: y + n + 1]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_plain_version(spark):
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    met = 0
    for d in docs:
        words = plain.WORD.findall(d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = all_runs(words, 24, 3) if len(words) < 3000 else runs_of(np.unique(words, return_inverse=True)[1], 24, 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        r, met = rows[d.doc_id], met + len(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == digest(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert met > 10


def test_cases(spark):
    round_ = "x y z " * 9
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, round_, 0), (None, round_, 0), (7, "a\x85b\xa0 " * 24, 0),
         (8, "w " * 300_000, 0), (9, "a b\n" * 11, 0), (10, "a b " * 12, 0)], "doc_id long, text string, runs int")
    found = periodic_runs(docs).collect()
    rows = {r.doc_id: r for r in found}
    assert [(rows[i].n_words, rows[i].runs, rows[i].collapsed) for i in (1, 2, 3)] == [(0, [], "")] * 3
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found if r.doc_id is None] == [(27, [(0, 27, 3)], "x y z")] * 2
    assert rows[7].n_words == 24 and rows[7].collapsed == "a\x85b\xa0"
    assert [tuple(x) for x in rows[8].runs] == [(0, 300_000, 1)] and rows[8].collapsed == "w"
    assert rows[9].runs == [] and [tuple(x) for x in rows[10].runs] == [(0, 24, 2)]
    assert periodic_runs(docs.where("doc_id < 0")).count() == 0
    assert kept_words(10, [(0, 6, 2), (3, 6, 3)]).tolist() == [True, True] + [False] * 7 + [True]
