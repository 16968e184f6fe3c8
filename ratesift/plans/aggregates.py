"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratesift.functions.scalars import r6
from ratesift.operators import aggregates as agg
from ratesift.operators import category_noise as cat
from ratesift.operators import coherence_noise as coh
from ratesift.operators import relational as rel
from ratesift.operators.ordering import dense_index, quantiles
from ratesift.plans.registry import query
from ratesift.plans.relational import clusters
from ratesift.session import durable


@query("d1_group_counts", "th", """SELECT 'user' AS side, userId AS id, CAST(count_if(rating < k) AS BIGINT) AS w,
    CAST(count_if(rating >= k AND rating < v) AS BIGINT) AS a, CAST(count_if(rating >= v) AS BIGINT) AS s FROM ratings, th GROUP BY userId UNION ALL
    SELECT 'item', itemId, CAST(count_if(rating < k) AS BIGINT), CAST(count_if(rating >= k AND rating < v) AS BIGINT),
    CAST(count_if(rating >= v) AS BIGINT)
    FROM ratings, th GROUP BY itemId""")
def group_counts(t):
    k, v = cat.cuts(t.stored)
    sides = [
        cat.group_counts(t.stored, key, k, v).select(F.lit(side).alias("side"), F.col(key).alias("id"), "w", "a", "s")
        for side, key in (("user", "userId"), ("item", "itemId"))
    ]
    return sides[0].unionByName(sides[1])


@query("d2_user_counts", "n_u", "SELECT userId, n_ratings FROM n_u")
def user_counts(t):
    return agg.count_by(t.ratings, "userId", name="n_ratings")


@query("d3_genre_means", "gm", "SELECT userId, genre, round(avg_rating, 6) AS avg_rating FROM gm")
def genre_means(t):
    return coh.genre_means(t.ratings, t.items).select("userId", "genre", r6(F.col("avg_rating")).alias("avg_rating"))


@query("d4_extremes", "coh1", """SELECT (SELECT min(rating) FROM ratings) AS r_min, (SELECT max(rating) FROM ratings) AS r_max,
    min(n_ratings) AS n_min, max(n_ratings) AS n_max, min(coherence) AS c_min, max(coherence) AS c_max FROM coh1""")
def extremes(t):
    r = t.stored.agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    scored = coh.coherence(t.stored, t.items)
    return scored.agg(
        F.min("n_ratings").alias("n_min"), F.max("n_ratings").alias("n_max"),
        F.min("coherence").alias("c_min"), F.max("coherence").alias("c_max"),
    ).select(r.select("lo").scalar().alias("r_min"), r.select("hi").scalar().alias("r_max"), "*")


@query("d5_quantiles", "n_u", """SELECT CAST(quantile_cont(n_ratings, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont(n_ratings, 0.5) AS DOUBLE) AS q50,
    CAST(quantile_cont(n_ratings, 0.75) AS DOUBLE) AS q75 FROM n_u""")
def count_quantiles(t):
    q = quantiles(agg.count_by(t.ratings, "userId"), "n", [0.25, 0.5, 0.75])
    return q.select(*[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


@query("d6_tier_medians", "tm", "SELECT tier, median_coherence FROM tm")
def tier_medians(t):
    scored = durable(coh.coherence(t.stored, t.items, normalised=True), "coherence")
    medians = coh.tier_medians(durable(coh.with_tiers(scored), "tiers"))
    return medians.select("tier", r6(F.col("median_coherence")).alias("median_coherence"))


@query("d7_size_report", "ratings", """SELECT count(DISTINCT userId) AS users, count(DISTINCT itemId) AS items,
    count(*) AS n_rows FROM ratings""")
def size_report(t):
    return agg.size_report(t.ratings)


@query("d8_polarity_counts", "ratings", """SELECT userId, count(*) AS total, CAST(count_if(rating > 3) AS BIGINT) AS positive,
    CAST(count_if(rating <= 3) AS BIGINT) AS negative FROM ratings GROUP BY userId""")
def polarity_counts(t):
    return agg.polarity_counts(t.ratings)


@query("d8_polarity_counts_trust", "ratings", """SELECT userId, count(*) AS total, CAST(count_if(rating > 4) AS BIGINT) AS positive,
    CAST(count_if(rating <= 4) AS BIGINT) AS negative FROM ratings GROUP BY userId""")
def polarity_counts_trust(t):
    return agg.polarity_counts(t.ratings, 4.0)


@query("d9_genre_sums", "rg", "SELECT userId, genre, sum(rating) AS genre_sum FROM rg GROUP BY userId, genre")
def genre_sums(t):
    return agg.genre_sums(t.ratings, t.items)


@query("d10_daily_activity", "ratings", """SELECT userId, CAST(make_timestamp(ts * 1000000) AS DATE) AS day, count(*) AS n,
    count(*) OVER (PARTITION BY userId) AS active_days FROM ratings GROUP BY 1, 2""")
def daily_activity(t):
    return agg.daily_activity(t.ratings)


@query("d11_user_title_means", "ratings items", """SELECT userId, title, round(avg(rating), 6) AS avg_rating
    FROM ratings JOIN items USING (itemId) GROUP BY 1, 2""")
def user_title_means(t):
    joined = rel.with_items(t.ratings, t.items.select("itemId", "title"))
    return joined.groupBy("userId", "title").agg(r6(F.avg("rating")).alias("avg_rating"))


@query("d12_most_rated", "ratings", "SELECT itemId, count(*) AS n FROM ratings GROUP BY 1 ORDER BY n DESC, itemId LIMIT 20")
def most_rated(t):
    return agg.most_rated(t.ratings, 20)


@query("d13_cluster_members", "clu ratings", "SELECT DISTINCT cluster, userId FROM ratings JOIN clu USING (userId)")
def cluster_members(t):
    """Members stay in rows: one list per cluster would grow with the users."""
    return t.ratings.join(clusters(t), "userId").select("cluster", "userId").distinct()


@query("d14_cluster_sizes", "clu", """SELECT cluster, count(*) AS n, round(avg(count(*)) OVER (), 6) AS mean_size FROM clu GROUP BY cluster""")
def cluster_sizes(t):
    sizes = agg.count_by(clusters(t), "cluster")
    return sizes.withColumn("mean_size", r6(sizes.agg(F.avg("n")).scalar()))


@query("d15_user_cluster_counts", "ratings items", """SELECT userId, itemId % 5 AS cluster, count(*) AS n FROM ratings GROUP BY 1, 2""")
def user_cluster_counts(t):
    """Ratings per user and cluster, for clusters of rating rows."""
    return agg.count_by(t.ratings.withColumn("cluster", F.col("itemId") % 5), "userId", "cluster")


@query("d17_label_distribution", "consensus", "SELECT label, count(*) AS n FROM consensus WHERE label IS NOT NULL GROUP BY label")
def label_distribution(t):
    from ratesift.operators.consensus import labelled
    from ratesift.plans.consensus import consensus

    return agg.count_by(labelled(consensus(t)), "label")


@query("d18_adjacency", "trust", """SELECT truster, trusted, CAST(sum(n) AS BIGINT) AS n FROM (SELECT truster, trusted, 1 AS n FROM trust
    UNION ALL SELECT DISTINCT id, id, 0 FROM (SELECT truster AS id FROM trust UNION SELECT trusted FROM trust)) GROUP BY 1, 2""")
def adjacency(t):
    return rel.adjacency(t.trust)


@query("d19_support_filter", "ratings", """SELECT userId, itemId, rating FROM ratings WHERE itemId IN (SELECT itemId FROM ratings
    GROUP BY itemId HAVING count(*) > 30) AND userId IN (SELECT userId FROM ratings WHERE itemId IN (SELECT itemId FROM ratings
    GROUP BY itemId HAVING count(*) > 30) GROUP BY userId HAVING count(*) > 20)""")
def support_filter(t):
    return rel.support_filter(t.ratings, 30, 20).select("userId", "itemId", "rating")


@query("d20_dense_index", "ratings", """SELECT userId, itemId, dense_rank() OVER (ORDER BY userId) - 1 AS user_idx,
    dense_rank() OVER (ORDER BY itemId) - 1 AS item_idx FROM ratings""")
def dense_ids(t):
    users = dense_index(t.stored, "userId", "user_idx")
    items = dense_index(t.stored, "itemId", "item_idx")
    return t.stored.select("userId", "itemId").join(users, "userId").join(items, "itemId")


@query("d21_genres", "rg", "SELECT DISTINCT unnest(string_split(genres, '|')) AS genre FROM items WHERE genres NOT LIKE '(%'")
def genres(t):
    return rel.distinct_genres(t.items)
