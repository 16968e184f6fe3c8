"""Consensus labels, feature encodings and opt-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratesift.operators import category_noise as cat
from ratesift.operators import coherence_noise as coh
from ratesift.operators import consensus as con
from ratesift.operators import features as fea
from ratesift.operators import fuzzy_noise as fuz
from ratesift.operators import neighbour_noise as nei
from ratesift.operators import optout as opt
from ratesift.plans.noise import split70
from ratesift.plans.registry import cte, query
from ratesift.session import durable

cte(
    "merged",
    """SELECT f3.userId, f3.itemId, f3.rating, f3.ts, nf1, nf2, nf3_1 AS nf3, nf4 FROM f3 JOIN f1 USING (userId, itemId)
    JOIN f2 USING (userId, itemId) JOIN f4 USING (userId, itemId)""",
    ("f1", "f2", "f3", "f4"),
)
cte(
    "consensus",
    """SELECT m.*, genres, CASE WHEN least(nf1, nf2, nf3, nf4) = 1 THEN 1 ELSE 0 END AS all_ones,
    CASE WHEN greatest(nf1, nf2, nf3, nf4) = 0 THEN 1 ELSE 0 END AS all_zeros,
    CASE WHEN least(nf1, nf2, nf3, nf4) = 1 THEN 1 WHEN greatest(nf1, nf2, nf3, nf4) = 0 THEN 0 END AS label
    FROM merged m LEFT JOIN items USING (itemId)""",
    ("merged", "items"),
)
cte(
    "optout",
    """SELECT userId, CASE WHEN n >= 0.5 * total AND n >= 3 THEN 1 ELSE 0 END AS OptOut FROM (SELECT userId,
    count_if(nf1 = 1) AS n, count(*) AS total FROM f1 GROUP BY userId) WHERE n > 0""",
    ("f1",),
)
cte("genre_list", "SELECT DISTINCT unnest(string_split(genres, '|')) AS genre FROM items WHERE genres NOT LIKE '(%'", ("items",))


def consensus(t):
    return con.consensus_table(t.stored, t.items)


def opt_out(t):
    return opt.opt_out_users(cat.flag_category_noise(t.stored), "nf1")


@query("j1_merge_filters", "merged", "SELECT userId, itemId, nf1, nf2, nf3, nf4 FROM merged")
def merge_filters(t):
    train, test = split70(t)
    third = nei.flag_neighbour_noise(nei.knn_with_means(train, test), test, con.WIDE_MISS)
    third = durable(third.select("userId", "itemId", "nf3"), "nf3")
    parts = [
        (cat.flag_category_noise(t.stored), "nf1"),
        (coh.flag_coherence_noise(t.stored, t.items), "nf2"),
        (third, "nf3"),
        (fuz.flag_fuzzy_noise(t.stored), "nf4"),
    ]
    return con.merge_filters(t.stored.select("userId", "itemId"), parts)


@query("j2_agreement", "consensus", "SELECT userId, itemId, all_ones, all_zeros FROM consensus")
def agreement(t):
    return consensus(t).select("userId", "itemId", "all_ones", "all_zeros")


@query("j3_label", "consensus", "SELECT userId, itemId, rating, ts, genres, nf1, nf2, nf3, nf4, label FROM consensus")
def label(t):
    return consensus(t).drop("all_ones", "all_zeros")


@query("j4_labelled_split", "consensus", """SELECT CASE WHEN label IS NULL THEN 'score' ELSE 'train' END AS part, userId, itemId
    FROM consensus""")
def labelled_split(t):
    table = durable(consensus(t), "consensus")  # read by both parts
    train = con.labelled(table).select(F.lit("train").alias("part"), "userId", "itemId")
    return train.unionByName(con.unlabelled(table).select(F.lit("score").alias("part"), "userId", "itemId"))


@query("k1_genre_bits", "items genre_list", """SELECT itemId, bits, CAST(list_sum(list_transform(range(1, len(bits) + 1), lambda i: CASE WHEN bits[i] = '1' THEN 1::BIGINT << (len(bits) - i)::INT ELSE 0 END)) AS BIGINT) AS number FROM (SELECT itemId, string_agg(CASE WHEN
    list_contains(string_split(genres, '|'), genre) THEN '1' ELSE '0' END, '' ORDER BY genre) AS bits FROM items, genre_list GROUP BY itemId)""")
def genre_bits(t):
    names = fea.genre_names(t.items)
    genres = F.col("genres")
    return t.items.select(
        "itemId", fea.genre_bits(genres, names).alias("bits"), fea.genre_number(genres, names).alias("number")
    )


@query("k2_one_hot", "f1", """SELECT userId, itemId, CASE WHEN rating_group = 'Wu' THEN 1 ELSE 0 END AS "rating_group_Wu",
    CASE WHEN rating_group = 'Au' THEN 1 ELSE 0 END AS "rating_group_Au", CASE WHEN rating_group = 'Su' THEN 1 ELSE 0 END
    AS "rating_group_Su" FROM f1""")
def one_hot(t):
    flagged = cat.flag_category_noise(t.stored).select("userId", "itemId", "rating_group")
    return fea.one_hot_columns(flagged, "rating_group", ["Wu", "Au", "Su"]).drop("rating_group")


@query("m1_noisy_ratings", "f1", "SELECT userId, itemId, rating FROM f1 WHERE nf1 = 1")
def noisy_ratings(t):
    return opt.noisy_ratings(cat.flag_category_noise(t.stored), "nf1").select("userId", "itemId", "rating")


@query("m2_opt_out_users", "optout", "SELECT userId, OptOut FROM optout")
def opt_out_users(t):
    return opt_out(t)


@query("m3_ratings_with_opt_out", "f1 optout", """SELECT userId, itemId, rating, nf1, coalesce(OptOut, 0) AS OptOut FROM f1
    LEFT JOIN optout USING (userId)""")
def ratings_with_opt_out(t):
    flagged = cat.flag_category_noise(t.stored)
    return opt.attach_opt_out(flagged, opt.opt_out_users(flagged, "nf1")).select(
        "userId", "itemId", "rating", "nf1", "OptOut"
    )


@query("m4_layer3_result", "f1 optout", """SELECT userId, itemId, CASE WHEN nf1 = 1 AND coalesce(OptOut, 0) = 0 THEN 1 ELSE 0 END
    AS layer3_result FROM f1 LEFT JOIN optout USING (userId)""")
def layer3_result(t):
    flagged = cat.flag_category_noise(t.stored)
    attached = opt.attach_opt_out(flagged, opt.opt_out_users(flagged, "nf1"))
    return opt.layer3_result(attached, "nf1").select("userId", "itemId", "layer3_result")
