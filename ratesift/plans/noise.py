"""Noise filters: thresholds, groups, profiles, neighbours and the flags of each filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratesift.functions.scalars import r6
from ratesift.operators import category_noise as cat
from ratesift.operators import coherence_noise as coh
from ratesift.operators import fuzzy_noise as fuz
from ratesift.operators import neighbour_noise as nei
from ratesift.operators.noise_report import noise_report
from ratesift.plans.registry import cte, query
from ratesift.session import durable

cte(
    "th",
    """SELECT r_min, r_max, r_min + third AS k, r_max - third AS v FROM (SELECT min(rating) AS r_min,
    max(rating) AS r_max, CAST(round_even((max(rating) - min(rating)) / 3, 0) AS DOUBLE) AS third FROM ratings)""",
    ("ratings",),
)
cte(
    "uc",
    """SELECT userId, CASE WHEN w >= a + s THEN 'Critical' WHEN a >= w + s THEN 'Average' WHEN s >= w + a
    THEN 'Benevolent' ELSE 'Variable' END AS user_cat FROM (SELECT userId, count_if(rating < k) AS w,
    count_if(rating >= k AND rating < v) AS a, count_if(rating >= v) AS s FROM ratings, th GROUP BY userId)""",
    ("th",),
)
cte(
    "ic",
    """SELECT itemId, CASE WHEN w >= a + s THEN 'Weakly-preferred' WHEN a >= w + s THEN 'Averagely-preferred'
    WHEN s >= w + a THEN 'Strongly-preferred' ELSE 'Variably-preferred' END AS item_cat FROM (SELECT itemId,
    count_if(rating < k) AS w, count_if(rating >= k AND rating < v) AS a, count_if(rating >= v) AS s
    FROM ratings, th GROUP BY itemId)""",
    ("th",),
)
cte(
    "f1",
    """SELECT r.*, CASE WHEN rating < k THEN 'Wu' WHEN rating < v THEN 'Au' ELSE 'Su' END AS rating_group,
    user_cat, item_cat, CASE WHEN (user_cat = 'Critical' AND item_cat = 'Weakly-preferred' AND rating >= k)
    OR (user_cat = 'Average' AND item_cat = 'Averagely-preferred' AND rating >= v AND rating < k)
    OR (user_cat = 'Benevolent' AND item_cat = 'Strongly-preferred' AND rating < v) THEN 1 ELSE 0 END AS nf1
    FROM ratings r JOIN uc USING (userId) JOIN ic USING (itemId), th""",
    ("uc", "ic"),
)
cte("gm", "SELECT userId, genre, avg(rating) AS avg_rating FROM rg GROUP BY userId, genre", ("rg",))
cte("n_u", "SELECT userId, count(*) AS n_ratings FROM ratings GROUP BY userId", ("ratings",))
cte(
    "spread",
    """SELECT userId, sum(s) AS total FROM (SELECT userId, genre, sqrt(var_pop(rating) * count(*)) AS s
    FROM rg GROUP BY userId, genre) GROUP BY userId""",
    ("rg",),
)
cte(
    "coh1",
    "SELECT userId, n_ratings, round(-coalesce(total, 0), 6) AS coherence FROM n_u LEFT JOIN spread USING (userId)",
    ("n_u", "spread"),
)
cte(
    "coh2",
    """SELECT userId, n_ratings, round(coalesce(total, 0) / sqrt(n_ratings), 6) AS coherence
    FROM n_u LEFT JOIN spread USING (userId)""",
    ("n_u", "spread"),
)
cte(
    "g1",
    """SELECT userId, n_ratings, coherence, CASE WHEN n_ratings * 3 >= m * 2 THEN 'H' WHEN n_ratings * 3 >= m THEN 'M'
    ELSE 'L' END || CASE WHEN coherence >= lo / 2 THEN 'EUG' ELSE 'DUG' END AS user_group
    FROM coh1, (SELECT max(n_ratings) AS m, min(coherence) AS lo FROM coh1)""",
    ("coh1",),
)
cte(
    "tiers",
    """SELECT userId, n_ratings, CASE WHEN n_ratings >= q75 THEN 'heavy' WHEN n_ratings >= q50 THEN 'medium'
    ELSE 'light' END AS tier FROM n_u, (SELECT quantile_cont(n_ratings, 0.5) AS q50,
    quantile_cont(n_ratings, 0.75) AS q75 FROM n_u)""",
    ("n_u",),
)
cte(
    "tm",
    """SELECT tier, round(median(coherence), 6) AS median_coherence FROM tiers JOIN coh2 USING (userId)
    GROUP BY tier""",
    ("tiers", "coh2"),
)
cte(
    "g2",
    """SELECT userId, t.n_ratings, coherence, upper(tier[1]) || CASE WHEN coherence >= median_coherence THEN 'EUG'
    ELSE 'DUG' END AS user_group FROM tiers t JOIN coh2 USING (userId) JOIN tm USING (tier)""",
    ("tm",),
)
cte(
    "dev",
    """SELECT rg.userId, rg.itemId, abs(rg.rating - avg_rating) / avg_rating AS d
    FROM rg JOIN gm USING (userId, genre)""",
    ("rg", "gm"),
)
cte(
    "f2a",
    """SELECT r.userId, r.itemId, rating, user_group, coalesce(rnd, 0) AS rnd,
    CASE WHEN coalesce(rnd, 0) > 0 THEN 1 ELSE 0 END AS nf2 FROM ratings r JOIN g1 USING (userId) LEFT JOIN (
    SELECT userId, itemId, avg(CASE WHEN round(d, 9) > CASE WHEN user_group IN ('HEUG', 'HDUG') THEN 0.075 ELSE 0.05
    END THEN 1.0 ELSE 0.0 END) AS rnd FROM dev JOIN g1 USING (userId) GROUP BY userId, itemId) USING (userId, itemId)""",
    ("dev", "g1"),
)
cte(
    "f2",
    """SELECT userId, itemId, rating, user_group, rnd, thresh, CASE WHEN rnd > thresh THEN 1 ELSE 0 END AS nf2 FROM (
    SELECT r.userId, r.itemId, rating, user_group, CASE WHEN coalesce(m, 0) > CASE WHEN user_group IN ('HEUG', 'HDUG')
    THEN 0.075 ELSE 0.05 END THEN m ELSE 0 END AS rnd, CAST(CASE WHEN user_group IN ('HEUG', 'HDUG', 'MEUG', 'MDUG')
    THEN 0.075 ELSE 0.05 END AS DOUBLE) AS thresh FROM ratings r JOIN g2 USING (userId) LEFT JOIN (SELECT userId, itemId,
    round(avg(d), 9) AS m FROM dev GROUP BY userId, itemId) USING (userId, itemId))""",
    ("dev", "g2"),
)
SHARP = "CASE WHEN {0} > 0.35 THEN ({0} - 0.35) / (1 - 0.35) ELSE {0} END"
LOW = "CASE WHEN rating <= 1.5 THEN 1.0 WHEN rating < 2 THEN (2 - rating) / 0.5 ELSE 0.0 END"
MEDIUM = """CASE WHEN rating < 1.5 OR rating > 4 THEN 0.0 WHEN rating < 2 THEN (rating - 1.5) / 0.5
    WHEN rating <= 3 THEN 1.0 ELSE 4.0 - rating END"""
HIGH = "CASE WHEN rating < 3 THEN 0.0 WHEN rating < 4 THEN rating - 3.0 ELSE 1.0 END"
cte(
    "fr",
    f"""SELECT userId, itemId, rating, {SHARP.format('l')} AS r_low, {SHARP.format('m')} AS r_medium,
    {SHARP.format('h')} AS r_high FROM (SELECT *, CAST({LOW} AS DOUBLE) AS l, CAST({MEDIUM} AS DOUBLE) AS m,
    CAST({HIGH} AS DOUBLE) AS h FROM ratings)""",
    ("ratings",),
)
for name, key, p in (("fu", "userId", "u"), ("fi", "itemId", "i")):
    cte(
        name,
        f"""SELECT {key}, round({SHARP.format('l')}, 9) AS {p}_low, round({SHARP.format('m')}, 9) AS {p}_medium,
        round({SHARP.format('h')}, 9) AS {p}_high FROM (SELECT {key}, round(avg(r_low), 9) AS l,
        round(avg(r_medium), 9) AS m, round(avg(r_high), 9) AS h FROM fr GROUP BY {key})""",
        ("fr",),
    )


def _fuzzy(distance: str) -> str:
    return f"""SELECT userId, itemId, rating, eligible, degree, CASE WHEN eligible = 1 AND degree >= 1 THEN 1 ELSE 0 END
    AS nf4 FROM (SELECT userId, itemId, rating, CASE WHEN round({distance}, 9) < 1
    AND NOT (u_low < 0.01 AND u_medium < 0.01 AND u_high < 0.01)
    AND NOT (i_low < 0.01 AND i_medium < 0.01 AND i_high < 0.01) THEN 1 ELSE 0 END AS eligible,
    round(least(abs(u_low - r_low) + abs(u_medium - r_medium) + abs(u_high - r_high),
    abs(i_low - r_low) + abs(i_medium - r_medium) + abs(i_high - r_high)), 9) AS degree
    FROM fr JOIN fu USING (userId) JOIN fi USING (itemId))"""


cte("f4", _fuzzy("abs(u_low - i_low)"), ("fr", "fu", "fi"))
cte("f4_full", _fuzzy("abs(u_low - i_low) + abs(u_medium - i_medium) + abs(u_high - i_high)"), ("fr", "fu", "fi"))


def split_sql(ratio: float, source: str = "ratings", extra: str = "") -> str:
    return f"""SELECT userId, itemId, rating, ts{extra}, CASE WHEN row_number() OVER (PARTITION BY userId ORDER BY
    (userId * 7919 + itemId * 104729 + 42) % 1000003, itemId) <= round_even(count(*) OVER (PARTITION BY userId)
    * CAST({ratio} AS DOUBLE), 0) THEN 1 ELSE 0 END AS is_train FROM {source}"""


cte("split70", split_sql(0.7), ("ratings",))
cte("train", "SELECT userId, itemId, rating, ts FROM split70 WHERE is_train = 1", ("split70",))
cte("test", "SELECT userId, itemId, rating, ts FROM split70 WHERE is_train = 0", ("split70",))
cte(
    "pair_msd",
    """SELECT a.userId AS u, b.userId AS v, count(*) AS shared, 1 / (avg((a.rating - b.rating) * (a.rating - b.rating)) + 1)
    AS sim FROM train a JOIN train b ON a.itemId = b.itemId AND a.userId <> b.userId GROUP BY 1, 2""",
    ("train",),
)
cte(
    "pair_pearson",
    """SELECT a.userId AS u, b.userId AS v, count(*) AS shared, CASE
    WHEN count(*) * sum(a.rating * a.rating) - sum(a.rating) * sum(a.rating) > 0
    AND count(*) * sum(b.rating * b.rating) - sum(b.rating) * sum(b.rating) > 0
    THEN (count(*) * sum(a.rating * b.rating) - sum(a.rating) * sum(b.rating)) / sqrt(
    (count(*) * sum(a.rating * a.rating) - sum(a.rating) * sum(a.rating)) *
    (count(*) * sum(b.rating * b.rating) - sum(b.rating) * sum(b.rating))) ELSE 0 END AS sim
    FROM train a JOIN train b ON a.itemId = b.itemId AND a.userId <> b.userId GROUP BY 1, 2""",
    ("train",),
)
cte("um", "SELECT userId, avg(rating) AS mean FROM train GROUP BY userId", ("train",))


def _knn(pairs: str, k: int) -> str:
    return f"""SELECT t.userId, t.itemId, t.rating, t.ts, round(least(greatest(CASE WHEN um.mean IS NULL OR known.itemId IS NULL
    THEN (SELECT avg(rating) FROM train) ELSE um.mean + coalesce(shift, 0) END, (SELECT min(rating) FROM train)), (SELECT max(rating) FROM train)), 9) AS est
    FROM test t LEFT JOIN um USING (userId) LEFT JOIN (SELECT DISTINCT itemId FROM train) known USING (itemId)
    LEFT JOIN (SELECT userId, itemId, sum(sim * dev) / sum(sim) AS shift FROM (
        SELECT t.userId, t.itemId, sim, n.rating - m.mean AS dev,
        row_number() OVER (PARTITION BY t.userId, t.itemId ORDER BY sim DESC, v) AS rn
        FROM test t JOIN train n ON n.itemId = t.itemId JOIN {pairs} ON u = t.userId AND v = n.userId
        JOIN um m ON m.userId = n.userId WHERE sim > 0) WHERE rn <= {k} GROUP BY 1, 2) USING (userId, itemId)"""


cte("knn", _knn("pair_msd", 40), ("test", "pair_msd", "um"))
cte("knn_pearson", _knn("pair_pearson", 35), ("test", "pair_pearson", "um"))
cte(
    "f3",
    """SELECT *, CASE WHEN miss > 0.05 THEN 1 ELSE 0 END AS nf3, CASE WHEN miss > 0.4 THEN 1 ELSE 0 END AS nf3_1 FROM (
    SELECT userId, itemId, rating, ts, est, abs(rating - round_even(est * 100, 0) / 100)
    / (SELECT max(rating) - min(rating) FROM knn) AS miss FROM knn)""",
    ("knn",),
)


@query("i1a_nf1_thresholds", "th", "SELECT r_min, r_max, k, v FROM th")
def nf1_thresholds(t):
    return cat.thresholds(t.ratings)


@query("i1b_nf1_rating_group", "f1", "SELECT userId, itemId, rating, rating_group FROM f1")
def nf1_rating_group(t):
    k, v = cat.cuts(t.stored)
    return t.stored.select(
        "userId", "itemId", "rating", cat.rating_group(F.col("rating"), k, v).alias("rating_group")
    )


@query("i1c_nf1_user_category", "uc", "SELECT userId, user_cat FROM uc")
def nf1_user_category(t):
    return cat.user_categories(t.stored, *cat.cuts(t.stored))


@query("i1d_nf1_item_category", "ic", "SELECT itemId, item_cat FROM ic")
def nf1_item_category(t):
    return cat.item_categories(t.stored, *cat.cuts(t.stored))


@query("i1e_nf1", "f1", "SELECT userId, itemId, rating, rating_group, user_cat, item_cat, nf1 FROM f1")
def nf1(t):
    return cat.flag_category_noise(t.stored).select(
        "userId", "itemId", "rating", "rating_group", "user_cat", "item_cat", "nf1"
    )


@query("i1e_nf1_paper", "f1", """SELECT userId, itemId, CASE WHEN nf1 = 1 OR (user_cat = 'Average' AND item_cat =
    'Averagely-preferred' AND (rating < k OR rating >= v)) THEN 1 ELSE 0 END AS nf1 FROM f1, th""")
def nf1_paper(t):
    return cat.flag_category_noise(t.stored, cat.CategoryNoise(mode="paper")).select("userId", "itemId", "nf1")


@query("i2a_coherence", "coh1", "SELECT userId, n_ratings, coherence FROM coh1")
def coherence(t):
    return coh.coherence(t.ratings, t.items)


@query("i2b_user_group", "g1", "SELECT userId, n_ratings, coherence, user_group FROM g1")
def user_group(t):
    return coh.user_groups(t.ratings, t.items, "thirds")


@query("i2c_coherence_v2", "coh2", "SELECT userId, n_ratings, coherence FROM coh2")
def coherence_v2(t):
    return coh.coherence(t.ratings, t.items, normalised=True)


@query("i2d_user_group_v2", "g2", "SELECT userId, n_ratings, coherence, user_group FROM g2")
def user_group_v2(t):
    return coh.user_groups(t.ratings, t.items)


@query("i2f_rnd_fraction", "f2a", "SELECT userId, itemId, rating, user_group, round(rnd, 6) AS rnd, nf2 FROM f2a")
def rnd_fraction(t):
    flagged = coh.flag_coherence_noise(t.stored, t.items, coh.CoherenceNoise("fraction", "thirds"))
    return flagged.select("userId", "itemId", "rating", "user_group", r6(F.col("rnd")).alias("rnd"), "nf2")


@query("i2g_rnd_mean", "f2", "SELECT userId, itemId, rating, user_group, round(rnd, 6) AS rnd, thresh, nf2 FROM f2")
def rnd_mean(t):
    flagged = coh.flag_coherence_noise(t.stored, t.items)
    return flagged.select("userId", "itemId", "rating", "user_group", r6(F.col("rnd")).alias("rnd"), "thresh", "nf2")


def split70(t):
    """Training and test ratings; the split is written once per query."""
    if not hasattr(t, "split70"):
        t.split70 = durable(nei.stratified_split(t.stored, 0.7), "split")
    parts = t.split70
    return parts.where("is_train = 1").drop("is_train"), parts.where("is_train = 0").drop("is_train")


@query("i3a_knn_with_means", "knn", "SELECT userId, itemId, rating, round(est, 6) AS est FROM knn")
def knn_with_means(t):
    return nei.knn_with_means(*split70(t)).select("userId", "itemId", "rating", r6(F.col("est")).alias("est"))


@query("i3a_knn_with_means_pearson", "knn_pearson", "SELECT userId, itemId, rating, round(est, 6) AS est FROM knn_pearson")
def knn_with_means_pearson(t):
    params = nei.NeighbourNoise(k=35, similarity="pearson")
    return nei.knn_with_means(*split70(t), params).select("userId", "itemId", "rating", r6(F.col("est")).alias("est"))


@query("i3b_nf3", "f3", "SELECT userId, itemId, rating, round(est, 6) AS est, nf3, nf3_1 FROM f3")
def nf3(t):
    train, test = split70(t)
    predicted = nei.knn_with_means(train, test)
    flagged = nei.flag_neighbour_noise(nei.flag_neighbour_noise(predicted, test, 0.05), test, 0.4, "nf3_1")
    return flagged.select("userId", "itemId", "rating", r6(F.col("est")).alias("est"), "nf3", "nf3_1")


@query("i4a_fuzzy_boundaries", "ratings", """SELECT label, a, b, c, d, count(*) AS n_full FROM (
    SELECT * FROM (VALUES ('low', 0.5::DOUBLE, 0.5::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE), ('medium', 1.5, 2.0, 3.0, 4.0),
    ('high', 3.0, 4.0, 5.0, 5.0)) x(label, a, b, c, d)) JOIN ratings ON rating BETWEEN b AND c GROUP BY ALL""")
def fuzzy_boundaries(t):
    """Corners of the three memberships and the ratings lying on each plateau."""
    scale = fuz.fitted(t.stored)
    corners = list(zip(fuz.LABELS, fuz.boundaries(scale.r_min, scale.r_max), strict=True))
    rows = [F.struct(F.lit(n).alias("label"), *[F.lit(float(x)).alias(c) for c, x in zip("abcd", v)]) for n, v in corners]
    on_plateau = t.stored.select("rating", F.explode(F.array(*rows)).alias("f")).select("rating", "f.*")
    return on_plateau.where("rating BETWEEN b AND c").groupBy("label", *"abcd").agg(F.count(F.lit(1)).alias("n_full"))


@query("i4b_fuzzy_rating_profile", "fr", """SELECT userId, itemId, rating, round(r_low, 6) AS r_low,
    round(r_medium, 6) AS r_medium, round(r_high, 6) AS r_high FROM fr""")
def fuzzy_rating_profile(t):
    return t.stored.select("userId", "itemId", "rating", *fuz.rating_profile(fuz.fitted(t.stored))).select(
        "userId", "itemId", "rating", *[r6(F.col(f"r_{x}")).alias(f"r_{x}") for x in fuz.LABELS]
    )


@query("i4c_fuzzy_profile_user", "fu", """SELECT userId, round(u_low, 6) AS u_low, round(u_medium, 6) AS u_medium,
    round(u_high, 6) AS u_high FROM fu""")
def fuzzy_profile_user(t):
    return fuz.profile_by(t.stored, "userId", "u").select(
        "userId", *[r6(F.col(f"u_{x}")).alias(f"u_{x}") for x in fuz.LABELS]
    )


@query("i4c_fuzzy_profile_item", "fi", """SELECT itemId, round(i_low, 6) AS i_low, round(i_medium, 6) AS i_medium,
    round(i_high, 6) AS i_high FROM fi""")
def fuzzy_profile_item(t):
    return fuz.profile_by(t.stored, "itemId", "i").select(
        "itemId", *[r6(F.col(f"i_{x}")).alias(f"i_{x}") for x in fuz.LABELS]
    )


@query("i4d_fuzzy_prefilter", "f4", "SELECT userId, itemId, rating FROM f4 WHERE eligible = 1")
def fuzzy_prefilter(t):
    return fuz.flag_fuzzy_noise(t.stored).where("eligible = 1").select("userId", "itemId", "rating")


@query("i4e_nf4", "f4", "SELECT userId, itemId, rating, eligible, degree, nf4 FROM f4")
def nf4(t):
    return fuz.flag_fuzzy_noise(t.stored).select(
        "userId", "itemId", "rating", "eligible", "degree", "nf4"
    )


@query("i4e_nf4_full_distance", "f4_full", "SELECT userId, itemId, eligible, nf4 FROM f4_full")
def nf4_full(t):
    return fuz.flag_fuzzy_noise(t.stored, fuz.FuzzyNoise(full=True)).select("userId", "itemId", "eligible", "nf4")


@query("i5_noise_report", "f1 f2 f3 f4", """SELECT filter, count(DISTINCT userId) AS users, count(DISTINCT itemId) AS items,
    count(*) AS n_rows, CAST(sum(flag) AS BIGINT) AS noisy, round(avg(flag), 6) AS noisy_share FROM (
    SELECT 'nf1' AS filter, userId, itemId, nf1 AS flag FROM f1 UNION ALL SELECT 'nf2', userId, itemId, nf2 FROM f2
    UNION ALL SELECT 'nf3', userId, itemId, nf3 FROM f3 UNION ALL SELECT 'nf4', userId, itemId, nf4 FROM f4) GROUP BY filter""")
def report(t):
    """All four filters; the prediction filter counts the ratings it tests."""
    flagged = fuz.flag_fuzzy_noise(coh.flag_coherence_noise(cat.flag_category_noise(t.stored), t.items))
    return noise_report(flagged, ["nf1", "nf2", "nf4"]).unionByName(noise_report(nf3(t), ["nf3"]))
