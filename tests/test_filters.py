"""Every branch of the noise filters on literal frames."""

import pytest
from pyspark.sql import functions as F

from ratesift.functions import scalars as s
from ratesift.operators import category_noise as cat
from ratesift.operators import coherence_noise as coh
from ratesift.operators import fuzzy_noise as fuz
from ratesift.operators import optout as opt


def collect(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_thresholds_follow_the_scale(frame):
    half = cat.thresholds(frame([(1, 1, 0.5), (1, 2, 5)])).first()
    five = cat.thresholds(frame([(1, 1, 1), (1, 2, 5)])).first()
    assert (half.k, half.v) == (2.5, 3.0)
    assert (five.k, five.v) == (2.0, 4.0)


@pytest.mark.parametrize("counts, user, item", [
    ((2, 1, 1), "Critical", "Weakly-preferred"),  # tie goes to the weak group
    ((1, 2, 1), "Average", "Averagely-preferred"),
    ((1, 1, 2), "Benevolent", "Strongly-preferred"),
    ((2, 2, 2), "Variable", "Variably-preferred"),
])
def test_categories(frame, counts, user, item):
    values = [1.0] * counts[0] + [3.0] * counts[1] + [5.0] * counts[2]
    ratings = frame([(1, i, r) for i, r in enumerate(values)])
    k, v = F.lit(2.0), F.lit(4.0)
    assert collect(cat.user_categories(ratings, k, v), "userId", "user_cat") == {1: user}
    flipped = ratings.select(F.col("itemId").alias("userId"), F.col("userId").alias("itemId"), "rating")
    assert collect(cat.item_categories(flipped, k, v), "itemId", "item_cat") == {1: item}


def test_category_noise_flags_contradictions(frame):
    critical = [(1, i, 1) for i in range(1, 6)] + [(2, i, 1) for i in range(1, 6)]
    flagged = cat.flag_category_noise(frame(critical + [(1, 9, 5), (3, 9, 1), (2, 9, 1)]))
    noisy = {(r.userId, r.itemId) for r in flagged.where("nf1 = 1").collect()}
    assert noisy == {(1, 9)}
    assert flagged.count() == 13


def test_average_clause_only_in_paper_mode(frame):
    middle = [(u, i, 3) for u in (1, 2, 3) for i in (1, 2, 3, 4)]
    extreme = [r for r in middle if r[:2] != (1, 1)] + [(1, 1, 5), (9, 50, 1)]
    for mode, expected in (("reference", 0), ("paper", 1)):
        flagged = cat.flag_category_noise(frame(extreme), cat.CategoryNoise(mode, 2.0, 4.0))
        assert flagged.where("userId = 1 AND itemId = 1").first().nf1 == expected


def test_missing_rating_is_never_noisy(spark):
    ratings = spark.createDataFrame([(1, 1, None), (1, 2, 1.0), (2, 1, 5.0)], "userId long, itemId long, rating double")
    assert cat.flag_category_noise(ratings).where("rating IS NULL").first().nf1 == 0


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(
        [(1, "a", "Drama|Comedy"), (2, "b", "Drama"), (3, "c", "(no genres listed)"), (4, "d", " Comedy ")],
        "itemId long, title string, genres string")


def test_genre_lists_are_trimmed_and_exact(spark, items):
    lists = {r.itemId: r.g for r in items.select("itemId", s.genre_array(F.col("genres")).alias("g")).collect()}
    assert lists == {1: ["Drama", "Comedy"], 2: ["Drama"], 3: [], 4: ["Comedy"]}
    member = items.select("itemId", s.has_genre(F.col("genres"), "Com").alias("exact"),
                          s.has_genre(F.col("genres"), "Com", substring=True).alias("sub"))
    assert {r.itemId for r in member.where("exact").collect()} == set()
    assert {r.itemId for r in member.where("sub").collect()} == {1, 4}


def test_coherence(frame, items):
    ratings = frame([(1, 1, 2), (1, 2, 4), (1, 3, 5), (2, 3, 1)])
    # Drama: 2, 4 around 3 gives sqrt(2); Comedy alone gives 0; sentinel items count nowhere.
    assert collect(coh.coherence(ratings, items), "userId", "coherence") == {1: -round(2**0.5, 6), 2: 0.0}
    normalised = collect(coh.coherence(ratings, items, normalised=True), "userId", "coherence")
    assert normalised[1] == pytest.approx(2**0.5 / 3**0.5, abs=1e-6)


def test_rnd_at_the_threshold_is_not_noisy(spark, frame, items):
    ratings = frame([(1, 2, 3.8), (1, 1, 4.2), (2, 2, 3.7), (2, 1, 4.3), (3, 3, 5)])
    groups = spark.createDataFrame([(1, "LEUG"), (2, "HEUG"), (3, "HDUG")], "userId long, user_group string")
    fraction = {(r.userId, r.itemId): r.rnd for r in coh.rnd_fraction(ratings, items, groups).collect()}
    assert fraction[1, 2] == 0.0  # deviation 0.05 at threshold 0.05
    assert fraction[2, 2] == 0.0  # deviation 0.075 at threshold 0.075
    assert fraction[3, 3] == 0.0  # no genres
    tighter = spark.createDataFrame([(2, "LEUG")], "userId long, user_group string")
    assert coh.rnd_fraction(ratings.where("userId = 2"), items, tighter).where("itemId = 2").first().rnd == 1.0


def test_mean_form_uses_both_thresholds(spark, frame, items):
    ratings = frame([(1, 2, 3.75), (1, 1, 4.25)])  # Drama deviation 0.0625
    groups = spark.createDataFrame([(1, "MEUG")], "userId long, user_group string")
    row = coh.rnd_mean(ratings, items, groups).where("itemId = 2").first()
    assert row.rnd == pytest.approx(0.0625) and row.thresh == 0.075 and row.nf2 == 0


def test_memberships_match_hand_values(spark):
    ratings = spark.createDataFrame([(x / 4,) for x in range(2, 21)], "rating double")
    low, medium, high = fuz.boundaries(0.5, 5.0)
    rows = ratings.select("rating", *[s.trapezoid(F.col("rating"), *c).alias(n) for n, c in
                                      (("low", low), ("medium", medium), ("high", high))]).collect()
    for r in rows:
        x = r.rating
        assert r.low == pytest.approx(1 if x <= 1.5 else max(0, 4 - 2 * x))
        assert r.medium == pytest.approx(max(0, min(1, 2 * x - 3, 4 - x)))
        assert r.high == pytest.approx(min(1, max(0, x - 3)))
        assert 0 <= min(r.low, r.medium, r.high) and max(r.low, r.medium, r.high) <= 1


def test_fuzzy_noise(frame):
    low_fans = [(u, i, 1) for u in (1, 2, 3) for i in range(1, 7)]
    flagged = fuz.flag_fuzzy_noise(frame([r for r in low_fans if r[:2] != (1, 1)] + [(1, 1, 5)]))
    noisy = {(r.userId, r.itemId) for r in flagged.where("nf4 = 1").collect()}
    assert noisy == {(1, 1)}
    assert flagged.count() == 18


def test_distant_profiles_are_not_eligible(frame):
    # User 1 rates everything low, item 9 is rated high by everyone else: low memberships 1 against about 0.
    rows = [(1, i, 1) for i in range(1, 30)] + [(u, 9, 5) for u in range(2, 200)] + [(1, 9, 1)]
    rows = [r for r in rows if r[:2] != (1, 9)] + [(1, 9, 1)]
    row = fuz.flag_fuzzy_noise(frame(rows), fuz.FuzzyNoise(full=True)).where("userId = 1 AND itemId = 9").first()
    assert row.eligible == 0 and row.nf4 == 0


def test_variable_profile_is_not_eligible(spark):
    profile = spark.createDataFrame([(0.0, 0.005, 0.0, 0.5, 0.5, 0.0)],
                                    "u_low double, u_medium double, u_high double, i_low double, i_medium double, i_high double")
    assert profile.select(fuz.eligible().alias("e")).first().e is False


def test_opt_out(spark):
    flagged = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 3 + [(2, 1)] * 2 + [(3, 0)], "userId long, isNoisy int")
    assert collect(opt.opt_out_users(flagged), "userId", "OptOut") == {1: 1, 2: 0}
    attached = opt.layer3_result(opt.attach_opt_out(flagged, opt.opt_out_users(flagged)))
    assert {(r.userId, r.isNoisy): r.layer3_result for r in attached.collect()} == {
        (1, 1): 0, (1, 0): 0, (2, 1): 1, (3, 0): 0}


def test_small_functions(spark):
    row = spark.createDataFrame([("user: 1 item: 2 r_ui = 3.00 est = 3.4567 {}", "101")], "t string, b string").select(
        s.estimate_from_text(F.col("t")).alias("est"), s.bits_to_number(F.col("b")).alias("n"),
        s.half_even(F.lit(2.5)).alias("r"), s.grid(0.0, 1.0, 3).alias("g"), s.ratio(F.lit(1), F.lit(0)).alias("z"),
    ).first()
    assert (row.est, row.n, row.r, row.g, row.z) == (3.45, 5, 2.0, [0.0, 0.5, 1.0], 0.0)


def test_common_noise_of_three_filters(spark):
    from ratesift.operators.consensus import common_noise, without_common_noise

    ratings = spark.createDataFrame([(1, i, 3.0) for i in range(8)] + [(1, 7, 4.0)], "userId long, itemId long, rating double")
    flagged = [
        (ratings.selectExpr("userId", "itemId", f"CAST(CAST(shiftright(itemId, {b}) AS INT) & 1 AS INT) AS nf{b}"), f"nf{b}") for b in range(3)
    ]
    flagged[2] = (flagged[2][0].where("itemId <> 3"), "nf2")  # not scored: not common
    assert [tuple(r) for r in common_noise(flagged).collect()] == [(1, 7)]
    left = without_common_noise(ratings, flagged)
    assert sorted(r.itemId for r in left.collect()) == list(range(7))
    assert without_common_noise(ratings.where("itemId = 7"), flagged).count() == 0
    assert common_noise([(df.where("itemId < 0"), n) for df, n in flagged]).count() == 0
