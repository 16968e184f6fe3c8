"""Skew-safe operators against brute force, with hot keys and forced small blocks."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ratesift.operators import clustering as clu
from ratesift.operators import metrics as met
from ratesift.operators import neighbour_noise as nei
from ratesift.operators import ordering as od
from ratesift.operators import recommend as rec
from ratesift.operators import sampling as sam
from ratesift.operators.vectors import VectorPlan, block_top_k


@pytest.fixture(scope="module")
def skewed():
    """A third of the ratings on one item, another hot user."""
    rng = random.Random(5)
    cells = {(u, 0) for u in range(60)} | {(7, i) for i in range(40)}
    while len(cells) < 240:
        cells.add((rng.randrange(60), rng.randrange(40)))
    return [(u, i, rng.randrange(1, 11) / 2) for u, i in sorted(cells)]


def pairs_of(rows):
    by_user = defaultdict(dict)
    for u, i, r in rows:
        by_user[u][i] = r
    for u, v in itertools.permutations(by_user, 2):
        shared = by_user[u].keys() & by_user[v].keys()
        if shared:
            yield u, v, [(by_user[u][i], by_user[v][i]) for i in shared]


def test_co_rating_summary(frame, skewed):
    expected = defaultdict(lambda: [0, 0, 0])
    for u, _, shared in pairs_of(skewed):
        e = expected[u]
        e[0], e[1], e[2] = e[0] + 1, e[1] + len(shared), max(e[2], len(shared))
    found = nei.co_rating_summary(frame(skewed), block=16).collect()
    assert {r.userId: [r.neighbours, r.shared, r.best_shared] for r in found} == dict(expected)


@pytest.mark.parametrize("similarity", ["msd", "pearson"])
def test_top_neighbours(frame, skewed, similarity):
    def sim(shared):
        if similarity == "msd":
            return 1 / (sum((x - y) ** 2 for x, y in shared) / len(shared) + 1)
        n, sx, sy = len(shared), sum(x for x, _ in shared), sum(y for _, y in shared)
        vx, vy = n * sum(x * x for x, _ in shared) - sx**2, n * sum(y * y for _, y in shared) - sy**2
        return (n * sum(x * y for x, y in shared) - sx * sy) / math.sqrt(vx * vy) if vx > 0 and vy > 0 else 0

    ranked = defaultdict(list)
    for u, v, shared in pairs_of(skewed):
        if sim(shared) > 0:
            ranked[u].append((-sim(shared), v))
    expected = {(u, v) for u, found in ranked.items() for _, v in sorted(found)[:5]}
    found = nei.top_neighbours(frame(skewed), 5, similarity, block=16).collect()
    assert {(r.userId, r.neighbour) for r in found} == expected


def test_knn_handles_unknown_keys_and_no_neighbour(frame):
    train = frame([(1, 1, 4), (1, 2, 2), (2, 1, 4), (2, 2, 2), (2, 3, 5), (4, 9, 1)])
    test = frame([(1, 3, 5), (3, 1, 4), (1, 8, 3), (4, 3, 2)])
    est = {(r.userId, r.itemId): r.est for r in nei.knn_with_means(train, test).collect()}
    overall = 18 / 6
    assert est[1, 3] == pytest.approx(3 + (5 - 11 / 3), abs=1e-8)  # identical neighbour
    assert est[3, 1] == pytest.approx(overall) and est[1, 8] == pytest.approx(overall)
    assert est[4, 3] == 1.0  # known, but nobody shares an item


def test_serendipity_matches_pairs(frame, skewed):
    ratings = frame(skewed)
    recs = rec.recommend_popular(ratings, 3)
    users = defaultdict(set)
    history = defaultdict(set)
    for u, i, _ in skewed:
        users[i].add(u)
        history[u].add(i)
    for r in met.serendipity(recs, ratings, block=8).collect():
        sims = [len(users[r.itemId] & users[j]) / math.sqrt(len(users[r.itemId]) * len(users[j])) for j in history[r.userId]]
        assert r.serendipity == pytest.approx(1 - sum(sims) / len(sims))


def test_popular_recommendations_skip_seen_and_fill_up(frame, skewed):
    seen, count = defaultdict(set), defaultdict(int)
    for u, i, _ in skewed:
        seen[u].add(i)
        count[i] += 1
    order = sorted(count, key=lambda i: (-count[i], i))
    found = defaultdict(dict)
    for r in rec.recommend_popular(frame(skewed), 4).collect():
        found[r.userId][r.rank] = r.itemId
    for u in seen:
        assert [found[u][k] for k in sorted(found[u])] == [i for i in order if i not in seen[u]][:4]


def test_concordance(spark):
    rng = random.Random(3)
    rows = [(u, rng.randrange(1, 11) / 2, rng.randrange(0, 6) / 2) for u in range(4) for _ in range(25)]
    good = total = 0
    for (u, r, e), (v, q, f) in itertools.combinations(rows, 2):
        if u == v and r != q:
            total += 1
            good += (r - q) * (e - f) > 0
    df = spark.createDataFrame(rows, "userId long, rating double, est double")
    assert met.concordance(df, [i / 2 for i in range(1, 11)]).first().fcp == pytest.approx(good / total)


def test_ranks_medians_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.random(), n) for n in range(101)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    ranked = {r.n: r["rank"] for r in od.global_rank(df, [F.asc("x")]).collect()}
    assert [n for n, _ in sorted(ranked.items(), key=lambda t: t[1])] == [n for _, _, n in sorted(rows, key=lambda t: t[1])]
    medians = {r.g: r.m for r in od.group_medians(df, ["g"], "x", "m").collect()}
    for g in "ab":
        xs = sorted(x for h, x, _ in rows if h == g)
        assert medians[g] == pytest.approx((xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2)
    index = {r.n: r.idx for r in od.dense_index(df.union(df), "n").collect()}
    assert index == {n: n for n in range(101)}


def test_samples_are_exact_and_repeatable(spark, frame):
    ratings = frame([(u, i, 3) for u in range(40) for i in range(20)])
    first = {(r.userId, r.itemId) for r in sam.sample_n(ratings, 123).collect()}
    assert len(first) == 123 and first == {(r.userId, r.itemId) for r in sam.sample_n(ratings, 123).collect()}
    labelled = ratings.withColumn("label", (F.col("userId") < 2).cast("int"))
    drawn = sam.class_weighted_sample(labelled, "label", 60, 1).groupBy("label").count().collect()
    counts = {r.label: r["count"] for r in drawn}
    assert sum(counts.values()) == 60 and counts[1] > 12  # 5 % of the rows, about half of the sample's weight
    weights = sam.bootstrap(ratings, 3).agg(F.sum("weight"), F.count("*")).first()
    assert 700 < weights[0] < 900 and sam.bootstrap(ratings, 3).count() + sam.out_of_bag(ratings, 3).count() == 800


def test_split_is_a_partition_with_the_share(frame, skewed):
    split = nei.stratified_split(frame(skewed), 0.7)
    for r in split.groupBy("userId").agg(F.sum("is_train").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == round(0.7 * r.n)


def test_histories_across_chunks(spark):
    events = spark.createDataFrame([(n, n % 2, n, "c", n // 3) for n in range(60)],
                                   "event_id long, userId long, itemId long, category string, ts long")
    rows = {r.event_id: r for r in rec.histories(events, length=3, chunk=4).collect()}
    assert len(rows) == 60
    for n, r in rows.items():
        mine = [m for m in range(60) if m % 2 == n % 2 and m < n][-3:]
        assert r.history_itemId == ",".join(map(str, mine))


def test_negatives_are_distinct_and_unseen(spark):
    seen = [(1, i) for i in range(0, 20, 2)] + [(2, i) for i in range(18)] + [(3, i) for i in range(20)]
    rows = spark.createDataFrame([(n, u, i) for n, (u, i) in enumerate(seen)], "instance long, userId long, itemId long")
    catalogue = spark.range(20).select(F.col("id").alias("itemId"))
    drawn = defaultdict(list)
    for r in rec.negative_draws(rows, catalogue, rows, 4).collect():
        drawn[r.instance].append((r.userId, r.itemId))
    for n, (u, _) in enumerate(seen):
        found = drawn[n]
        assert len(found) == len(set(found)) == {1: 4, 2: 2, 3: 0}[u]
        assert not set(found) & set(seen)


def test_components_along_a_chain(spark):
    chain = [(n, n + 1, 1) for n in range(40)] + [(100, 101, 1), (40, 100, -1)]
    trust = spark.createDataFrame(chain, "truster long, trusted long, value int")
    found = {r.userId: r.component for r in clu.trust_components(trust).collect()}
    assert found == {**{n: 0 for n in range(41)}, 100: 100, 101: 100}


def test_block_top_k_hides_seen(spark):
    rng = random.Random(2)
    left = [(n, [rng.random() for _ in range(3)]) for n in range(30)]
    right = [(n, [rng.random() for _ in range(3)]) for n in range(25)]
    hidden = {(n, m) for n in range(30) for m in range(25) if (n + m) % 3 == 0}
    build = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>")
    seen = spark.createDataFrame(sorted(hidden), "id long, other long")
    best = od.top_per_group(block_top_k(build(left), build(right), VectorPlan(k=4, block=8), seen),
                            ["id"], [F.desc("score"), F.asc("other")], 4)
    found = {(r.id, r["rank"]): r.other for r in best.collect()}
    for n, x in left:
        scores = sorted((-round(sum(a * b for a, b in zip(x, y)), 9), m) for m, y in right if (n, m) not in hidden)
        assert [found[n, k] for k in range(1, 5)] == [m for _, m in scores[:4]]
