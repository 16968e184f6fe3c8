"""Keys that meet few others: whole lists in one task, against brute force."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from ratesift.operators import blocks
from ratesift.operators.blocks import BlockPlan, pair_statistics

FACTS = "key long, dim long, val double"


def sparse(seed, users=120, dims=90, each=6):
    rng = random.Random(seed)
    return [(u + 2**33, d, rng.randint(1, 10) / 2) for u in range(users) for d in rng.sample(range(dims), each)]


def similar(rows):
    by_dim, sums = defaultdict(list), defaultdict(lambda: [0, 0.0])
    for u, d, v in rows:
        by_dim[d].append((u, v))
    for held in by_dim.values():
        for u, x in held:
            for w, y in held:
                if u != w:
                    sums[u, w][0] += 1
                    sums[u, w][1] += (x - y) ** 2
    return {p: (n, 1 / (s / n + 1)) for p, (n, s) in sums.items()}


def test_neighbours_of_a_key_leave_one_task_complete(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 3)
    rows = sparse(1)
    facts = spark.createDataFrame([*rows, (None, 5, 1.0), (7, None, 1.0)], FACTS)
    pairs = similar(rows)
    found = pair_statistics(facts, BlockPlan(reduce="neighbours", k=4, block=8)).collect()
    got = defaultdict(list)
    for r in found:
        got[r.key].append((-round(r.sim, 9), r.other, r.shared))
    want = defaultdict(list)
    for (u, w), (n, s) in pairs.items():
        want[u].append((-round(s, 9), w, n))
    # no more than k rows a key, although there are 15 blocks of keys
    assert {u: sorted(x) for u, x in got.items()} == {u: sorted(x)[:4] for u, x in want.items()}
    counted = pair_statistics(facts, BlockPlan(reduce="summary", block=8)).collect()
    assert {r.key: (r.neighbours, r.shared, r.best_shared) for r in counted} == {
        u: (len(x), sum(n for *_, n in x), max(n for *_, n in x)) for u, x in want.items()
    }


def test_estimates_and_sums_equal_brute_force_on_both_routes(spark, monkeypatch):
    rows, asked = sparse(2), [(u, d, 0.0) for u, d, _ in sparse(3, each=3)]
    facts, queries = spark.createDataFrame(rows, FACTS), spark.createDataFrame(asked, FACTS)
    pairs, held = similar(rows), defaultdict(list)
    for u, d, v in rows:
        held[d].append((u, v))
    mean, total = {}, {}
    for u, d, _ in asked:
        near = sorted((-pairs[u, w][1], w, v) for w, v in held[d] if (u, w) in pairs)
        if near:
            total[u, d] = -sum(s for s, *_ in near)
            near = near[:2]
            mean[u, d] = sum(s * v for s, _, v in near) / sum(s for s, *_ in near)
    for most in (blocks.MEAN_PAIRS, 0):
        monkeypatch.setattr(blocks, "MEAN_PAIRS", most)
        for copies in (blocks.ASKED_PAIRS, 5):
            monkeypatch.setattr(blocks, "ASKED_PAIRS", copies)
            found = blocks.weighted_means(facts, BlockPlan(k=2, block=8), queries, facts).collect()
            assert {(r.key, r.dim) for r in found} == set(mean)
            assert all(math.isclose(r["mean"], mean[r.key, r.dim], rel_tol=1e-9) for r in found)
        sums = pair_statistics(facts, BlockPlan(reduce="sum", block=8), queries, facts)
        found = sums.groupBy("key", "dim").agg(F.sum("sim").alias("sim")).collect()
        assert {(r.key, r.dim): round(r.sim, 9) for r in found} == {p: round(s, 9) for p, s in total.items()}


def test_copies_of_sparse_ratings_stay_below_their_block_pairs(spark):
    """Rows sent are one for each (key block, dimension), not one for each pair of blocks."""
    facts = spark.createDataFrame(sparse(4), FACTS)
    plan = BlockPlan(block=4)
    listed = blocks.list_rows(facts, facts, plan, blocks._loads(facts, facts))
    assert listed.count() * 2 < blocks.routed_rows(facts, plan).count()
