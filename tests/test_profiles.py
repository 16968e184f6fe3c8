"""Registered profile queries on literal ratings."""

from ratesift.plans import catalog
from ratesift.plans.registry import PLANS


def test_manhattan_size_of_the_rating_profile(spark, frame):
    catalog.load()

    class Tables:
        ratings = stored = frame([(u, i, (u * 3 + i) % 10 / 2 + 0.5) for u in range(4) for i in range(5)])

    sizes = PLANS["g11_manhattan"](Tables()).collect()
    parts = PLANS["i4b_fuzzy_rating_profile"](Tables()).collect()
    want = {(r.userId, r.itemId): round(abs(r.r_low) + abs(r.r_medium) + abs(r.r_high), 5) for r in parts}
    assert {(r.userId, r.itemId): round(r["size"], 5) for r in sizes} == want
