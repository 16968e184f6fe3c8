"""Ranking metrics, diversity, serendipity and group validation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ratesift.functions.scalars import r6
from ratesift.operators import category_noise as cat
from ratesift.operators import fuzzy_noise as fuz
from ratesift.operators import groupval as gv
from ratesift.operators import metrics as met
from ratesift.operators import neighbour_noise as nei
from ratesift.operators import recommend as rec
from ratesift.operators.relational import clean_view
from ratesift.plans.noise import split70
from ratesift.plans.registry import CTES, NEEDS, cte, query
from ratesift.plans.relational import clusters
from ratesift.session import durable

cte("pop", """SELECT itemId, CAST(count(*) AS DOUBLE) AS prediction FROM train GROUP BY itemId""", ("train",))
cte(
    "recs",
    """SELECT userId, itemId, prediction, rank FROM (SELECT u.userId, p.itemId, prediction, row_number() OVER
    (PARTITION BY u.userId ORDER BY prediction DESC, p.itemId) AS rank FROM (SELECT DISTINCT userId FROM train) u
    CROSS JOIN pop p ANTI JOIN train t ON t.userId = u.userId AND t.itemId = p.itemId) WHERE rank <= 10""",
    ("pop",),
)
cte(
    "hits",
    """SELECT a.userId, coalesce(hit, 0) AS hit, actual, coalesce(dcg, 0) AS dcg,
    list_sum(list_transform(range(1, least(actual, 10) + 1), lambda r: 1 / ln(1 + r))) AS idcg, coalesce(ap, 0) / actual AS ap
    FROM (SELECT userId, count(*) AS actual FROM test WHERE userId IN (SELECT userId FROM recs) GROUP BY userId) a
    LEFT JOIN (SELECT userId, count(*) AS hit, sum(1 / ln(1 + rank)) AS dcg, sum(nth / rank) AS ap FROM (SELECT r.userId, rank,
    row_number() OVER (PARTITION BY r.userId ORDER BY rank) AS nth FROM recs r JOIN test USING (userId, itemId)) GROUP BY userId) USING (userId)""",
    ("recs", "test"),
)
cte("pair_items", """SELECT a.itemId AS i, b.itemId AS j, count(*) AS n FROM train a JOIN train b ON a.userId = b.userId
    AND a.itemId <> b.itemId GROUP BY 1, 2""", ("train",))
cte(
    "ser",
    """SELECT r.userId, r.itemId, 1 - sum(coalesce(n / sqrt(pi.prediction * pj.prediction), 0)) / count(*) AS serendipity
    FROM recs r JOIN train h ON h.userId = r.userId LEFT JOIN pair_items p ON p.i = r.itemId AND p.j = h.itemId
    JOIN pop pi ON pi.itemId = r.itemId JOIN pop pj ON pj.itemId = h.itemId GROUP BY 1, 2""",
    ("recs", "pair_items"),
)
cte("like", """SELECT userId, genre, count(*) / sum(count(*)) OVER (PARTITION BY userId) AS likelihood FROM rg GROUP BY 1, 2""", ("rg",))
cte("enough", "SELECT userId FROM test GROUP BY userId HAVING count(*) > 5", ("test",))
cte("ig", "SELECT itemId, unnest(string_split(genres, '|')) AS genre FROM items WHERE genres NOT LIKE '(%'", ("items",))
cte(
    "dv",
    """SELECT userId, sum(likelihood * 0.5 ** seen / log2(rank + 1)) AS dcg FROM (SELECT r.userId, r.itemId, rank, ig.genre,
    count(*) OVER (PARTITION BY r.userId, ig.genre ORDER BY rank) - 1 AS seen FROM recs r JOIN ig USING (itemId) WHERE rank <= 5) x
    JOIN "like" USING (userId, genre) JOIN test USING (userId, itemId) WHERE userId IN (SELECT userId FROM enough) GROUP BY userId""",
    ("recs", "ig", "like", "enough"),
)
cte("want", "SELECT userId, itemId FROM test WHERE userId IN (SELECT userId FROM enough)", ("enough",))


def _round(n: int) -> tuple[str, str, tuple[str, ...]]:
    picked = " UNION ALL ".join(f"SELECT userId, itemId FROM pick{i}" for i in range(1, n)) or "SELECT NULL AS userId, NULL AS itemId WHERE false"
    return (
        f"pick{n}",
        f"""SELECT userId, itemId, gain FROM (SELECT w.userId, w.itemId, round(coalesce(sum(likelihood * 0.5 ** coalesce(used, 0)), 0), 9) AS gain,
        row_number() OVER (PARTITION BY w.userId ORDER BY round(coalesce(sum(likelihood * 0.5 ** coalesce(used, 0)), 0), 9) DESC, w.itemId) AS rn
        FROM want w LEFT JOIN ig ON ig.itemId = w.itemId LEFT JOIN "like" l ON l.userId = w.userId AND l.genre = ig.genre
        LEFT JOIN (SELECT userId, genre, count(*) AS used FROM ({picked}) JOIN ig USING (itemId) GROUP BY 1, 2) g
        ON g.userId = w.userId AND g.genre = ig.genre ANTI JOIN ({picked}) d ON d.userId = w.userId AND d.itemId = w.itemId
        GROUP BY w.userId, w.itemId) WHERE rn = 1""",
        ("want", "ig", "like", *[f"pick{i}" for i in range(1, n)]),
    )


for _n in range(1, 6):
    cte(*_round(_n))
cte(
    "ideal",
    "SELECT userId, sum(g) AS idcg FROM (" + " UNION ALL ".join(
        f"SELECT userId, gain / log2({i} + 1) AS g FROM pick{i}" for i in range(1, 6)) + ") GROUP BY userId",
    tuple(f"pick{i}" for i in range(1, 6)),
)
cte("dn", "SELECT e.userId, coalesce(dcg, 0) AS dcg, coalesce(idcg, 0) AS idcg FROM enough e LEFT JOIN dv USING (userId) LEFT JOIN ideal USING (userId)",
    ("enough", "dv", "ideal"))


def _on_cleaned(name: str) -> None:
    """The same entry over the training ratings that filter 1, fitted on them, calls clean."""
    first = {"ratings": "train", "th": "th_t", "uc": "uc_t", "ic": "ic_t", "f1": "f1_t"}
    then = {"train": "train_c", "pop": "pop_c", "recs": "recs_c", "hits": "hits_c"}
    renames = first if name in first else then
    swap = lambda text: re.sub(r"\b\w+\b", lambda m: renames.get(m[0], m[0]), text)
    cte(renames[name], swap(CTES[name]), tuple(renames.get(n, n) for n in NEEDS.get(name, ())))


for _name in ("th", "uc", "ic", "f1"):
    _on_cleaned(_name)
cte("train_c", "SELECT userId, itemId, rating, ts FROM f1_t WHERE nf1 = 0", ("f1_t",))
for _name in ("pop", "recs", "hits"):
    _on_cleaned(_name)
cte("ba", """SELECT userId, base, new, CASE WHEN new > base THEN 1 ELSE 0 END AS improved FROM (SELECT userId, round(dcg / idcg, 6) AS base
    FROM hits) JOIN (SELECT userId, round(dcg / idcg, 6) AS new FROM hits_c) USING (userId)""", ("hits", "hits_c"))


def popular_recommendations(t):
    """Training and test ratings and the ten most popular unseen items per user, written once per query."""
    train, test = split70(t)
    if not hasattr(t, "recs"):
        t.recs = durable(rec.recommend_popular(train, 10), "recs")
    return train, test, t.recs


def per_user_hits(t):
    _, test, recs = popular_recommendations(t)
    return met.user_hits(recs, test, 10)


def diversity(t):
    _, test, recs = popular_recommendations(t)
    return met.diversity_ndcg(recs, test, t.stored, t.items, 5)


def rounded(df, *columns):
    return df.select(*[r6(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("e2_top_k_unseen", "recs", "SELECT userId, itemId, prediction, rank FROM recs")
def top_k_unseen(t):
    return popular_recommendations(t)[2]


@query("e3_hits", "hits", "SELECT userId, hit, actual FROM hits")
def hits(t):
    return per_user_hits(t).select("userId", "hit", "actual")


@query("e4_rank_estimates", "knn", """SELECT userId, itemId, rank FROM (SELECT userId, itemId, row_number() OVER (PARTITION BY userId
    ORDER BY round(est, 6) DESC, itemId) AS rank FROM knn) WHERE rank <= 5""")
def rank_estimates(t):
    predicted = nei.knn_with_means(*split70(t)).withColumn("est", r6(F.col("est")))
    return met.rank_predictions(predicted, 5, "est").select("userId", "itemId", "rank")


@query("e6_running_redundancy", "recs ig", """SELECT userId, itemId, genre, count(*) OVER (PARTITION BY userId, genre ORDER BY rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM recs JOIN ig USING (itemId)""")
def running_redundancy(t):
    from pyspark.sql import Window

    from ratesift.functions.scalars import genre_array

    genres = t.items.select("itemId", F.explode(genre_array(F.col("genres"))).alias("genre"))
    before = Window.partitionBy("userId", "genre").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = popular_recommendations(t)[2].join(genres, "itemId")
    return ranked.select("userId", "itemId", "genre", F.count(F.lit(1)).over(before).alias("seen"))


@query("p1_precision_recall", "knn", """SELECT a.userId, round(CASE WHEN rc = 0 THEN 0 ELSE both_ / rc END, 6) AS precision,
    round(CASE WHEN relevant = 0 THEN 0 ELSE both_ / relevant END, 6) AS recall FROM (SELECT userId, count_if(rating >= 3.5) AS relevant
    FROM knn GROUP BY userId) a JOIN (SELECT userId, count_if(est >= 3.5) AS rc, count_if(est >= 3.5 AND rating >= 3.5) AS both_ FROM
    (SELECT userId, rating, round(est, 6) AS est, row_number() OVER (PARTITION BY userId ORDER BY round(est, 6) DESC, itemId) AS rn FROM knn)
    WHERE rn <= 10 GROUP BY userId) USING (userId)""")
def precision_recall(t):
    predicted = nei.knn_with_means(*split70(t)).withColumn("est", r6(F.col("est")))
    return rounded(met.precision_recall_at(predicted), "precision", "recall")


@query("p2_ndcg", "hits", "SELECT userId, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(dcg / idcg, 6) AS ndcg FROM hits")
def ndcg(t):
    scored = per_user_hits(t).select("userId", "dcg", "idcg").withColumn("ndcg", F.col("dcg") / F.col("idcg"))
    return rounded(scored, "dcg", "idcg", "ndcg")


@query("p3_precision_recall_mean", "hits", """SELECT round(avg(hit / 10), 6) AS precision, round(avg(hit / actual), 6) AS recall,
    round(avg(dcg / idcg), 6) AS ndcg, count(*) AS n_users FROM hits""")
def precision_recall_mean(t):
    return rounded(met.ranking_metrics(per_user_hits(t)).drop("map"), "precision", "recall", "ndcg")


@query("p4_map", "hits", "SELECT round(avg(ap), 6) AS map FROM hits")
def mean_average_precision(t):
    return rounded(met.ranking_metrics(per_user_hits(t)).select("map"), "map")


@query("p5_mae_rmse", "knn", "SELECT round(avg(abs(rating - est)), 6) AS mae, round(sqrt(avg((rating - est) * (rating - est))), 6) AS rmse FROM knn")
def mae_rmse(t):
    return rounded(met.rating_errors(nei.knn_with_means(*split70(t))), "mae", "rmse")


@query("p6_fcp", "knn", """SELECT round(sum(CASE WHEN round(a.est, 6) < round(b.est, 6) THEN 1 ELSE 0 END) / count(*), 6) AS fcp
    FROM knn a JOIN knn b ON a.userId = b.userId AND a.rating < b.rating""")
def fcp(t):
    train, test = split70(t)
    return rounded(met.concordance(nei.knn_with_means(train, test), met.rating_levels(test)), "fcp")


@query("p7_neighbourhood", "knn pair_msd hits", """SELECT u AS userId, round(avg(mae), 6) AS neighbour_mae, any_value(round(ndcg, 6)) AS ndcg
    FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rn FROM pair_msd) JOIN (SELECT userId AS v,
    avg(abs(rating - est)) AS mae FROM knn GROUP BY 1) USING (v) LEFT JOIN (SELECT userId AS u, dcg / idcg AS ndcg FROM hits) USING (u)
    WHERE rn <= 10 GROUP BY u""")
def neighbourhood(t):
    train, test = split70(t)
    predicted = nei.knn_with_means(train, test)
    errors = met.neighbourhood_mae(predicted, nei.top_neighbours(train, 10))
    gain = met.user_hits(rec.recommend_popular(train, 10), test).select("userId", (F.col("dcg") / F.col("idcg")).alias("ndcg"))
    return rounded(errors.join(gain, "userId", "left"), "neighbour_mae", "ndcg")


@query("p8_coverage", "recs train", """SELECT round(count(DISTINCT itemId) / (SELECT count(DISTINCT itemId) FROM train), 6) AS coverage FROM recs""")
def coverage(t):
    train, _, recs = popular_recommendations(t)
    return rounded(met.coverage(recs, train), "coverage")


@query("p9_serendipity", "ser", "SELECT userId, itemId, round(serendipity, 6) AS serendipity FROM ser")
def serendipity(t):
    train, _, recs = popular_recommendations(t)
    return rounded(met.serendipity(recs, train), "serendipity")


@query("p9_user_serendipity", "ser", "SELECT userId, round(avg(serendipity), 6) AS serendipity FROM ser GROUP BY userId")
def user_serendipity(t):
    train, _, recs = popular_recommendations(t)
    return rounded(met.user_serendipity(met.serendipity(recs, train)), "serendipity")


@query("c14_item_co_occurrence", "pair_items pop", """SELECT i AS itemId, j AS other, round(sim, 6) AS sim, rank FROM (SELECT i, j, sim,
    row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM (SELECT i, j, n / sqrt(a.prediction * b.prediction) AS sim
    FROM pair_items JOIN pop a ON a.itemId = i JOIN pop b ON b.itemId = j)) WHERE rank <= 20""")
def item_co_occurrence(t):
    """The items most often rated by the same users: top 20 per item."""
    from ratesift.operators.blocks import BlockPlan, pair_statistics
    from ratesift.operators.ordering import top_per_group

    train, _ = split70(t)
    popularity = train.groupBy("itemId").agg(F.count(F.lit(1)).alias("n"))
    facts = train.join(popularity, "itemId").select(
        F.col("itemId").alias("key"), F.col("userId").alias("dim"), F.col("n").alias("val")
    )
    found = pair_statistics(facts, BlockPlan(similarity="cosine", reduce="neighbours", k=20))
    named = found.select(F.col("key").alias("itemId"), "other", "sim")
    return rounded(top_per_group(named, ["itemId"], [F.desc("sim"), F.asc("other")], 20), "sim")


@query("d16_cluster_serendipity", "ser clu", """SELECT cluster, round(avg(s), 6) AS serendipity FROM (SELECT userId, avg(serendipity) AS s
    FROM ser GROUP BY userId) JOIN clu USING (userId) GROUP BY cluster""")
def cluster_serendipity(t):
    train, _, recs = popular_recommendations(t)
    per_user = met.user_serendipity(met.serendipity(recs, train))
    return per_user.join(clusters(t), "userId").groupBy("cluster").agg(r6(F.avg("serendipity")).alias("serendipity"))


@query("p10_genre_likelihood", "like", 'SELECT userId, genre, round(likelihood, 6) AS likelihood FROM "like"')
def genre_likelihood(t):
    return rounded(met.genre_likelihood(t.stored, t.items), "likelihood")


@query("p11_diversity_ndcg", "dn", "SELECT userId, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg FROM dn")
def diversity_ndcg(t):
    return rounded(diversity(t), "dcg", "idcg")


@query("p12_confusion", "f1 f4", """SELECT c.cls, round(CASE WHEN claimed = 0 THEN 0 ELSE hit / claimed END, 6) AS precision,
    round(CASE WHEN actual = 0 THEN 0 ELSE hit / actual END, 6) AS recall, round(accuracy, 6) AS accuracy FROM (SELECT x.cls,
    count_if(nf1 = cls AND nf4 = cls) AS hit, count_if(nf1 = cls) AS claimed, count_if(nf4 = cls) AS actual
    FROM f1 JOIN f4 USING (userId, itemId), (VALUES (0), (1)) x(cls) GROUP BY x.cls) c,
    (SELECT avg(CASE WHEN nf1 = nf4 THEN 1.0 ELSE 0 END) AS accuracy FROM f1 JOIN f4 USING (userId, itemId))""")
def confusion(t):
    """Filter 1 as a prediction of filter 4."""
    flagged = fuz.flag_fuzzy_noise(cat.flag_category_noise(t.stored))
    return rounded(met.confusion(flagged, "nf4", "nf1"), "precision", "recall", "accuracy")


def before_and_after(t):
    """Per-user hits with all training ratings, and with the noisy ones of filter 1 removed."""
    train, test = split70(t)
    flagged = cat.flag_category_noise(train).withColumnRenamed("nf1", "isNoisy")
    cleaned = durable(clean_view(flagged).select("userId", "itemId", "rating", "ts"), "cleaned")
    results = []
    for kept in (train, cleaned):
        hits = met.user_hits(durable(rec.recommend_popular(kept, 10), "recs"), test)
        results.append(hits.select("userId", r6(F.col("dcg") / F.col("idcg")).alias("ndcg")))
    return met.improvement(*results, "ndcg")


@query("c10_improved_users", "ba", "SELECT userId, base, new, improved FROM ba")
def improved_users(t):
    return before_and_after(t)


@query("d22_improved_share", "ba", """SELECT round(avg(improved) * 100, 6) AS percent_improved, CASE WHEN avg(improved) * 100 > 80 THEN 1 ELSE 0 END
    AS reached FROM ba""")
def improved_share(t):
    return rounded(met.improved_share(before_and_after(t)), "percent_improved")


_RATIO = "CASE WHEN {1} = 0 THEN {0} ELSE {0} / {1} END"


@query("q1_cluster_diversity", "dn clu", f"""WITH s AS (SELECT cluster, sum(dcg) AS d, sum(idcg) AS i FROM dn JOIN clu USING (userId) GROUP BY cluster),
    tt AS (SELECT sum(dcg) AS td, sum(idcg) AS ti FROM dn) SELECT cluster, round({_RATIO.format('d', 'i')}, 6) AS cluster_ndcg,
    round({_RATIO.format('round(td - d, 9)', 'round(ti - i, 9)')}, 6) AS equiv_ndcg FROM s, tt""")
def cluster_diversity(t):
    compared = gv.diversity_by_cluster(diversity(t), clusters(t))
    return rounded(compared.select("cluster", "cluster_ndcg", "equiv_ndcg"), "cluster_ndcg", "equiv_ndcg")


@query("q2_change", "dn clu", f"""WITH s AS (SELECT cluster, sum(dcg) AS d, sum(idcg) AS i FROM dn JOIN clu USING (userId) GROUP BY cluster),
    tt AS (SELECT sum(dcg) AS td, sum(idcg) AS ti FROM dn) SELECT cluster, round(td / ti, 6) AS total_ndcg,
    round((({_RATIO.format('d', 'i')}) - td / ti) / (td / ti) * 100, 4) AS perc_change,
    round(({_RATIO.format('d', 'i')}) - ({_RATIO.format('round(td - d, 9)', 'round(ti - i, 9)')}), 6) AS condition_1 FROM s, tt""")
def change(t):
    compared = gv.diversity_by_cluster(diversity(t), clusters(t))
    return rounded(compared.select("cluster", "total_ndcg", F.round("perc_change", 4).alias("perc_change"), "condition_1"),
                   "total_ndcg", "condition_1")


def _cluster_sql(rest: str) -> str:
    parts = []
    for name in ("ndcg", "precision", "recall"):
        r = rest.format(m=name)
        parts.append(f"round({name} / n, 6) AS cluster_{name}, round({r}, 6) AS cluster_{name}_eq, round(t_{name} / tn, 6) AS {name}")
    return f"""WITH sc AS (SELECT userId, dcg / idcg AS ndcg, hit / 10 AS precision, hit / actual AS recall FROM hits),
    s AS (SELECT cluster, count(*) AS n, coalesce(sum(ndcg), 0) AS ndcg, coalesce(sum(precision), 0) AS precision,
    coalesce(sum(recall), 0) AS recall FROM clu LEFT JOIN sc USING (userId) GROUP BY cluster),
    tt AS (SELECT count(*) AS tn, sum(ndcg) AS t_ndcg, sum(precision) AS t_precision, sum(recall) AS t_recall FROM sc)
    SELECT cluster, n, {', '.join(parts)} FROM s, tt"""


_METRIC_COLUMNS = [f"{p}{m}{s}" for m in ("ndcg", "precision", "recall") for p, s in (("cluster_", ""), ("cluster_", "_eq"), ("", ""))]


@query("q3_group_validation", "hits clu", _cluster_sql("(t_{m} - {m}) / (tn - n)"))
def group_validation(t):
    return rounded(gv.accuracy_by_cluster(per_user_hits(t), clusters(t)), *_METRIC_COLUMNS)


@query("q4_group_validation_scaled", "hits clu", _cluster_sql("{m} / n * n / (tn - n)"))
def group_validation_scaled(t):
    return rounded(gv.accuracy_by_cluster(per_user_hits(t), clusters(t), complement="scaled"), *_METRIC_COLUMNS)


@query("q5_baseline_columns", "hits clu", """SELECT cluster, round(avg(dcg / idcg), 6) AS cluster_mean,
    (SELECT round(avg(dcg / idcg), 6) FROM hits) AS ndcg, (SELECT round(avg(hit / 10), 6) FROM hits) AS precision
    FROM hits JOIN clu USING (userId) GROUP BY cluster""")
def baseline_columns(t):
    """Overall metrics next to each cluster's mean."""
    per_user = per_user_hits(t)
    overall = met.ranking_metrics(per_user).select(F.struct("ndcg", "precision")).scalar()
    means = per_user.join(clusters(t), "userId").groupBy("cluster").agg(F.avg(F.col("dcg") / F.col("idcg")).alias("cluster_mean"))
    joined = means.select("cluster", "cluster_mean", overall["ndcg"].alias("ndcg"), overall["precision"].alias("precision"))
    return rounded(joined, "cluster_mean", "ndcg", "precision")
