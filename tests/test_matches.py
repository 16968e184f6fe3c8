"""Routed pair sums, bounded and hashed matches, selection, samples, votes and scales against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratesift.operators import clustering as clu
from ratesift.operators import fuzzy_noise as fuz
from ratesift.operators import metrics as met
from ratesift.operators import neighbour_noise as nei
from ratesift.operators import ordering as od
from ratesift.operators import recommend as rec
from ratesift.operators import vectors as vec
from ratesift.operators.blocks import HALF, LOW, BlockPlan, routed_rows


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vec array<double>")


def test_rows_go_only_to_block_pairs_that_share_a_dimension(spark):
    rng = random.Random(1)
    rows = [(u, d, 1.0) for d in range(60) for u in rng.sample(range(64), 2)]
    facts = spark.createDataFrame(rows, "key long, dim long, val double")
    n_blocks = -(-len({u for u, _, _ in rows}) // 4)
    blocks = {r.key: r.b for r in facts.select("key", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("b")).distinct().collect()}
    holders = defaultdict(set)
    for u, d, _ in rows:
        holders[d].add(blocks[u])
    want = {(min(a, b), max(a, b), d) for d, own in holders.items() for a in own for b in own}
    routed = routed_rows(facts, BlockPlan(block=4)).collect()
    assert {(r.pair >> HALF, r.pair & LOW, r.dim) for r in routed} == want
    assert len(want) < len({*blocks.values()}) ** 2 * 60 / 4
    # each unordered pair of blocks gets a packed row once per side
    assert max(Counter((r.pair, r.dim, r.side) for r in routed).values()) == 1


def test_bounded_products_equal_all_products(spark):
    rng = np.random.default_rng(2)
    right = rng.normal(size=(400, 4)) * np.exp(-np.arange(400) / 60)[:, None]
    right[7] = right[8]  # equal scores go to the lower id
    left = rng.normal(size=(50, 4))
    hidden = {(n, m) for n in range(50) for m in range(400) if (n + m) % 5 == 0}
    seen = spark.createDataFrame(sorted(hidden), "id long, other long")
    trace: list = []
    found = vec.bounded_top_k(
        vectors(spark, enumerate(left)), vectors(spark, enumerate(right)), vec.VectorPlan(k=5, block=16), seen, trace
    ).collect()
    got = {(r.id, r["rank"]): r.other for r in found}
    for n, x in enumerate(left):
        order = sorted((-round(float(x @ y), 9), m) for m, y in enumerate(right) if (n, m) not in hidden)
        assert [got[n, k] for k in range(1, 6)] == [m for _, m in order[:5]]
    assert len(found) == 250
    share = sum(a * b for a, b in trace) / (50 * 400)
    assert share < 0.7 and len(trace) > 1, trace
    few = vec.bounded_top_k(vectors(spark, enumerate(left)), vectors(spark, [(0, right[0]), (1, right[1])]), vec.VectorPlan(k=5))
    assert few.count() == 100
    assert vec.bounded_top_k(vectors(spark, enumerate(left)), vectors(spark, []), vec.VectorPlan(k=5)).count() == 0


def test_hashed_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 6))
    points = centres[rng.integers(0, 30, 6000)] + 0.25 * rng.normal(size=(6000, 6))
    points = (points - points.mean(0)) / points.std(0)
    points[:2000] = points[0]  # a third of all rows in one place
    left, right = points[2000:2400], points[2400:]
    right = np.concatenate((right, points[:2000]))
    found = vec.hashed_top_k(
        vectors(spark, enumerate(left)), vectors(spark, enumerate(right)), vec.VectorPlan(k=5, metric="l2", block=256), 6,
        vec.HashPlan(wanted=300),
    ).collect()
    got = defaultdict(set)
    for r in found:
        got[r.id].add(r.other)
    hits = 0
    for n, x in enumerate(left):
        assert len(got[n]) == 5
        distance = ((right - x) ** 2).sum(1)
        hits += len(got[n] & set(np.lexsort((np.arange(len(right)), np.round(distance, 9)))[:5].tolist()))
    assert hits / (5 * len(left)) >= 0.9
    lonely = vec.hashed_top_k(vectors(spark, [(1, [99.0] * 6)]), vectors(spark, enumerate(right)), vec.VectorPlan(k=5, metric="l2"), 6)
    assert lonely.count() == 5


def test_medians_by_selection(spark, monkeypatch):
    monkeypatch.setattr(od, "MEDIAN_ROWS", 20)
    monkeypatch.setattr(od, "MEDIAN_PARTS", 4)
    rng = random.Random(4)
    rows = [("same", 7.0 if rng.random() < 0.8 else rng.random() * 100) for _ in range(500)]
    rows += [("wide", rng.gauss(0, 1) * 10 ** rng.randrange(6)) for _ in range(501)] + [("two", 1.0), ("two", 4.0), ("one", 3.0)]
    rows += [("gone", None), ("even", 1.0), ("even", 1.0)] + [("half", float(n % 2)) for n in range(300)]
    found = {r.g: r.m for r in od.group_medians(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "m").collect()}
    assert found.keys() == {"same", "wide", "two", "one", "even", "half"}
    for g, m in found.items():
        assert m == pytest.approx(float(np.median([x for h, x in rows if h == g])))


def test_smallest_rows(spark):
    rng = random.Random(5)
    rows = [(n, rng.randrange(0, 200), rng.randrange(3)) for n in range(900)]
    df = spark.createDataFrame(rows, "n long, key long, extra int")
    order = [n for _, n in sorted((k, n) for n, k, _ in rows)]
    for size in (0, 1, 17, 450, 899, 900, 5000):
        got = od.smallest_n(df, F.col("key"), ["n"], size)
        assert got.columns == df.columns
        assert sorted(r.n for r in got.collect()) == sorted(order[:size])
    asked = spark.range(33).agg(F.count(F.lit(1))).scalar()
    assert od.smallest_n(df, F.col("key"), ["n"], asked).count() == 33


def plain_votes(links):
    around = defaultdict(Counter)
    for a, b, w in links:
        if a != b:
            around[a][b] += w
            around[b][a] += w
    labels, met_ = {n: n for n in around}, []
    while True:
        new = {}
        for n, others in around.items():
            votes = Counter()
            for m, w in others.items():
                votes[labels[m]] += w
            new[n] = max(votes, key=lambda label: (votes[label], label == labels[n], -label))
        if new == labels:
            return new
        if new in met_:
            return {n: min(new[n], labels[n]) for n in new}
        met_.append(new)
        labels = new


def test_label_propagation_equals_a_plain_loop(spark):
    rng = random.Random(6)
    links = [(a, b, 1) for g in range(4) for a in range(10 * g, 10 * g + 10) for b in range(10 * g, a) if rng.random() < 0.6]
    links += [(100, rng.randrange(40), 1) for _ in range(len(links) // 2)]  # a hub with a third of the links
    links += [(200, 201, 1), (5, 5, 9), (7, 27, 1)]
    df = spark.createDataFrame(links, "a long, b long, weight int")
    found = {r.id: r.label for r in clu.label_propagation(df).collect()}
    assert found == plain_votes(links) and found[200] == found[201] == 200
    trust = spark.createDataFrame([(1, 2, 1), (2, 3, -1), (3, 4, 1)], "truster long, trusted long, value int")
    assert {r.userId: r.community for r in clu.trust_communities(trust).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert clu.label_propagation(df.where("a < 0")).count() == 0


def test_scales_come_from_the_ratings(spark, frame):
    ten = frame([(u, i, 1 + (u * 7 + i * 3) % 10) for u in range(12) for i in range(9)])
    params = fuz.fitted(ten)
    assert (params.r_min, params.r_max) == (1.0, 10.0)
    low, medium, high = fuz._corners(params)
    assert (low, high) == ((1.0, 1.0, 3.25, 4.6), (6.4, 7.75, 10.0, 10.0)) and medium[0] == 3.25
    assert fuz._corners(fuz.fitted(frame([(1, 1, 1), (1, 2, 5)])))[0] == (1.0, 1.0, 1.5, 2.0)
    assert fuz.flag_fuzzy_noise(ten).agg(F.max("degree")).first()[0] > 0
    split = nei.stratified_split(ten, 0.7)
    train, test = split.where("is_train = 1").drop("is_train"), split.where("is_train = 0").drop("is_train")
    est = [r.est for r in nei.knn_with_means(train, test).collect()]
    assert max(est) > 5 and min(est) >= 1 and max(est) <= 10
    levels = met.rating_levels(ten)
    assert levels == [float(n) for n in range(1, 11)]
    with pytest.raises(ValueError):
        met.rating_levels(ten, 9)


def test_factors_take_ids_of_any_size(spark):
    far = 1 << 40
    rows = [(far + u, 3 * far + i, 4.0) for u in range(12) for i in range(10) if (u + i) % 3]
    found = rec.factor_vectors(rec.fit_factors(spark.createDataFrame(rows, "userId long, itemId long, rating double"), rank=4)).collect()
    assert {r.id for r in found if r.kind == "u"} == {r[0] for r in rows}
    assert {r.id for r in found if r.kind == "i"} == {r[1] for r in rows}
