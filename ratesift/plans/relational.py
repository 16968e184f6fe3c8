"""Projections, filters and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ratesift.functions import scalars as s
from ratesift.operators import aggregates as agg
from ratesift.operators import category_noise as cat
from ratesift.operators import coherence_noise as coh
from ratesift.operators import fuzzy_noise as fuz
from ratesift.operators import neighbour_noise as nei
from ratesift.operators import relational as rel
from ratesift.plans.registry import cte, query
from ratesift.session import durable

cte("clu", "SELECT c_custkey AS userId, c_custkey % 7 AS cluster FROM customer")


def clusters(t):
    """A fixed user clustering."""
    return t.users.select("userId", (F.col("userId") % 7).alias("cluster"))


@query("b1_project", "ratings", "SELECT userId, itemId, rating, ts FROM ratings")
def project(t):
    return rel.project_ratings(t.ratings, with_time=True)


@query("b2_clean_view", "f1 f2 f4 optout", """SELECT 'flag' AS rule, userId, itemId FROM f1 WHERE nf1 = 0
    UNION ALL SELECT 'stacked', userId, itemId FROM f1 WHERE nf1 = 0
    UNION ALL SELECT 'all_ones', f1.userId, f1.itemId FROM f1 JOIN f2 USING (userId, itemId)
        JOIN f4 USING (userId, itemId) WHERE least(nf1, nf2, nf4) = 0
    UNION ALL SELECT 'both', f1.userId, f1.itemId FROM f1 JOIN f2 USING (userId, itemId)
        JOIN f4 USING (userId, itemId) WHERE least(nf1, nf2, nf4) = 0 AND greatest(nf1, nf2, nf4) = 1
    UNION ALL SELECT 'framework', userId, itemId FROM f1 LEFT JOIN optout USING (userId) WHERE nf1 = 0 OR coalesce(OptOut, 0) = 1""")
def clean_view(t):
    from ratesift.operators import optout as opt

    flagged = fuz.flag_fuzzy_noise(coh.flag_coherence_noise(cat.flag_category_noise(t.stored), t.items))
    flagged = durable(flagged.select("userId", "itemId", "nf1", "nf2", "nf4"), "flags")  # read by five rules
    flags = [F.col(c) for c in ("nf1", "nf2", "nf4")]
    table = flagged.select(
        "userId",
        "itemId",
        F.col("nf1").alias("isNoisy"),
        F.least(*flags).alias("all_ones"),
        s.flag(F.greatest(*flags) == 0).alias("all_zeros"),
    )
    stacked = table.withColumn("isNoisy", F.when(F.col("isNoisy") == 0, "[0.]").otherwise("[1.]"))
    opted = opt.attach_opt_out(flagged, opt.opt_out_users(flagged, "nf1"))
    framework = opt.layer3_result(opted, "nf1")
    views = [
        rel.clean_view(source, rule).select(F.lit(rule).alias("rule"), "userId", "itemId")
        for rule, source in (("flag", table), ("stacked", stacked), ("all_ones", table), ("both", table), ("framework", framework))
    ]
    return reduce(DataFrame.unionByName, views)


@query("b3_numeric_coercion", "items", """SELECT itemId, TRY_CAST(CASE WHEN genres LIKE '(%' THEN genres
    ELSE CAST(itemId AS VARCHAR) END AS DOUBLE) AS number FROM items""")
def numeric_coercion(t):
    text = F.when(F.col("genres").startswith("("), F.col("genres")).otherwise(F.col("itemId").cast("string"))
    return t.items.withColumn("raw", text).select("itemId", rel.to_number("raw").alias("number"))


@query("b4_strip_brackets", "f1", "SELECT userId, itemId, CAST(nf1 AS VARCHAR) || '.' AS isNoisy FROM f1")
def strip_brackets(t):
    stacked = cat.flag_category_noise(t.stored).withColumn("text", F.format_string("[%d.]", "nf1"))
    return stacked.select("userId", "itemId", rel.strip_brackets("text").alias("isNoisy"))


@query("b5_fix_merge_suffixes", "f1", "SELECT userId, itemId, rating, nf1 AS isNoisy FROM f1")
def fix_merge_suffixes(t):
    flagged = cat.flag_category_noise(t.stored)
    merged = flagged.select("userId", "itemId", F.col("rating").alias("rating_x"), F.col("nf1").alias("isNoisy_x"),
                            F.lit(0).alias("isNoisy_y"), F.col("rating").alias("rating_y"))
    return rel.fix_merge_suffixes(merged)


@query("b6_drop_optional", "ratings", "SELECT userId, itemId, rating FROM ratings")
def drop_optional(t):
    return rel.drop_optional(t.ratings, "ts", "title", "genres", "user_group")


@query("b7_zero_fill", "ratings users", """SELECT u.userId, coalesce(n, 0) AS n FROM users u LEFT JOIN
    (SELECT userId, count(*) AS n FROM ratings WHERE rating > 4 GROUP BY userId) USING (userId)""")
def zero_fill(t):
    high = agg.count_by(t.ratings.where("rating > 4"), "userId")
    return rel.zero_fill(t.users.select("userId").join(high, "userId", "left"), "n")


@query("b8_epoch_date", "ratings", "SELECT userId, itemId, CAST(make_timestamp(ts * 1000000) AS DATE) AS day FROM ratings")
def epoch_date(t):
    return t.ratings.select("userId", "itemId", rel.epoch_date().alias("day"))


@query("b9_genre_count", "items", "SELECT itemId, len(string_split(genres, '|')) AS n_genres FROM items")
def genre_count(t):
    return t.items.select("itemId", rel.genre_count().cast("long").alias("n_genres"))


@query("b10_rating_threshold", "ratings", """SELECT itemId, CAST(count_if(rating > 3) AS BIGINT) AS above, CAST(count_if(rating <= 3) AS BIGINT) AS not_above
    FROM ratings GROUP BY itemId""")
def rating_threshold(t):
    r = F.col("rating")
    return t.ratings.groupBy("itemId").agg(F.count_if(r > 3).alias("above"), F.count_if(r <= 3).alias("not_above"))


@query("b11_genre_membership", "items", """SELECT itemId, CASE WHEN list_contains(string_split(genres, '|'), 'ring')
    THEN 1 ELSE 0 END AS exact, CASE WHEN contains(genres, 'r') THEN 1 ELSE 0 END AS sub FROM items""")
def genre_membership(t):
    genres = F.col("genres")
    return t.items.select(
        "itemId", s.flag(s.has_genre(genres, "ring")).alias("exact"), s.flag(s.has_genre(genres, "r", True)).alias("sub")
    )


@query("b12_id_filter", "ratings users", """SELECT 'in' AS side, userId, itemId FROM ratings WHERE userId IN
    (SELECT userId FROM users WHERE gender = 'F') UNION ALL SELECT 'out', userId, itemId FROM ratings WHERE userId NOT IN
    (SELECT userId FROM users WHERE gender = 'F')""")
def id_filter(t):
    chosen = t.users.where("gender = 'F'")
    inside = rel.keep_ids(t.ratings, chosen, "userId").select(F.lit("in").alias("side"), "userId", "itemId")
    return inside.unionByName(rel.drop_ids(t.ratings, chosen, "userId").select(F.lit("out").alias("side"), "userId", "itemId"))


@query("c1_ratings_items", "ratings items", "SELECT userId, itemId, rating, title, genres FROM ratings JOIN items USING (itemId)")
def ratings_items(t):
    return rel.with_items(t.ratings, t.items).select("userId", "itemId", "rating", "title", "genres")


@query("c2_ratings_left_items", "ratings items", """SELECT userId, itemId, rating, genres FROM ratings LEFT JOIN
    (SELECT * FROM items WHERE genres NOT LIKE '(%') USING (itemId)""")
def ratings_left_items(t):
    listed = t.items.where(F.col("genres") != s.NO_GENRES)
    return rel.with_items(t.ratings, listed, "left").select("userId", "itemId", "rating", "genres")


@query("c3_ratings_left_groups", "ratings g2", "SELECT userId, itemId, rating, user_group FROM ratings LEFT JOIN g2 USING (userId)")
def ratings_left_groups(t):
    groups = coh.user_groups(t.stored, t.items).select("userId", "user_group")
    return t.stored.join(groups, "userId", "left").select("userId", "itemId", "rating", "user_group")


@query("c4_category_join", "f1", "SELECT userId, itemId, rating, user_cat, item_cat FROM f1")
def category_join(t):
    return cat.flag_category_noise(t.stored).select("userId", "itemId", "rating", "user_cat", "item_cat")


@query("c5_recover_timestamp", "f1", "SELECT userId, itemId, rating, nf1, ts FROM f1")
def recover_timestamp(t):
    flagged = cat.flag_category_noise(t.stored).select("userId", "itemId", "rating", "nf1")
    return rel.recover_timestamp(flagged, t.stored)


@query("c6_cluster_join", "ratings clu", "SELECT userId, itemId, rating, cluster FROM ratings JOIN clu USING (userId)")
def cluster_join(t):
    return t.ratings.drop("ts").join(clusters(t), "userId")


@query("c7_anti_rows", "log ratings", """SELECT userId, itemId, rating, ts FROM log l WHERE NOT EXISTS (SELECT 1 FROM ratings r
    WHERE r.userId = l.userId AND r.itemId = l.itemId AND r.rating = l.rating AND r.ts = l.ts)""")
def anti_rows(t):
    """Rating events that were superseded."""
    return rel.anti_rows(t.rating_log.select("userId", "itemId", "rating", "ts"), t.ratings)


@query("c8_ranking_hits", "recs test", """SELECT r.userId, r.itemId, rank, rating FROM recs r
    LEFT JOIN test USING (userId, itemId)""")
def ranking_hits(t):
    from ratesift.plans.evaluation import popular_recommendations

    train, test, recs = popular_recommendations(t)
    return recs.join(test, ["userId", "itemId"], "left").select("userId", "itemId", "rank", "rating")


@query("c9_attach_opt_out", "optout f1", """SELECT userId, itemId, coalesce(OptOut, 0) AS OptOut FROM f1
    LEFT JOIN optout USING (userId)""")
def attach_opt_out(t):
    from ratesift.operators.optout import attach_opt_out as attach
    from ratesift.plans.consensus import opt_out

    return attach(t.stored, opt_out(t)).select("userId", "itemId", "OptOut")


@query("c11_update_flag", "ratings f4", "SELECT userId, itemId, rating, nf4 FROM f4")
def update_flag(t):
    noisy = fuz.flag_fuzzy_noise(t.stored).where("nf4 = 1")
    return rel.attach_flag(t.stored.drop("ts"), noisy, "nf4")


@query("c12_restrict_edges", "trust users", """SELECT truster, trusted, value FROM trust WHERE truster IN (SELECT userId FROM
    users WHERE age < 40) AND trusted IN (SELECT userId FROM users WHERE age < 40)""")
def restrict_edges(t):
    return rel.restrict_edges(t.trust, t.users.where("age < 40")).select("truster", "trusted", "value")


@query("c13_co_rated", "ratings", """SELECT u AS userId, count(*) AS neighbours, CAST(sum(shared) AS BIGINT) AS shared,
    max(shared) AS best_shared FROM (SELECT a.userId AS u, b.userId AS v, count(*) AS shared FROM ratings a
    JOIN ratings b ON a.itemId = b.itemId AND a.userId <> b.userId GROUP BY 1, 2) GROUP BY u""")
def co_rated(t):
    return nei.co_rating_summary(t.stored).where("neighbours > 0")


@query("g1_guarded_arithmetic", "ratings um2", """SELECT userId, itemId, round(abs(rating - m), 6) AS gap,
    round((rating - m) * (rating - m), 6) AS square, round(sqrt(rating), 6) AS root,
    round(CASE WHEN sd = 0 THEN 0 ELSE (rating - m) / sd END, 6) AS z FROM ratings JOIN um2 USING (userId)""")
def guarded_arithmetic(t):
    stats = t.ratings.groupBy("userId").agg(F.avg("rating").alias("m"), F.stddev_pop("rating").alias("sd"))
    gap = F.col("rating") - F.col("m")
    return t.ratings.join(stats, "userId").select(
        "userId", "itemId", s.r6(F.abs(gap)).alias("gap"), s.r6(F.pow(gap, 2)).alias("square"),
        s.r6(F.sqrt("rating")).alias("root"), s.r6(s.ratio(gap, F.col("sd"))).alias("z"),
    )


cte("um2", "SELECT userId, avg(rating) AS m, stddev_pop(rating) AS sd FROM ratings GROUP BY userId", ("ratings",))


@query("g2_round_half_even", "ratings", "SELECT userId, itemId, CAST(round_even(rating, 0) AS DOUBLE) AS whole FROM ratings")
def round_half_even(t):
    return t.ratings.select("userId", "itemId", s.half_even(F.col("rating")).alias("whole"))


@query("g4_logarithms", "ratings", "SELECT userId, itemId, round(ln(1 + rating), 6) AS l1, round(log2(rating), 6) AS l2 FROM ratings")
def logarithms(t):
    return t.ratings.select("userId", "itemId", s.r6(F.log1p("rating")).alias("l1"), s.r6(F.log2("rating")).alias("l2"))


@query("g5_trapezoid", "ratings", """SELECT userId, itemId, CAST(CASE WHEN rating < 1.5 OR rating > 4 THEN 0 WHEN rating < 2
    THEN (rating - 1.5) / 0.5 WHEN rating <= 3 THEN 1 ELSE 4 - rating END AS DOUBLE) AS medium FROM ratings""")
def trapezoid(t):
    return t.ratings.select("userId", "itemId", s.trapezoid(F.col("rating"), *fuz.MEDIUM_CORNERS).alias("medium"))


@query("g6_sharpen", "ratings", """SELECT userId, itemId, round(CASE WHEN rating / 5 > 0.35 THEN (rating / 5 - 0.35) / 0.65
    ELSE rating / 5 END, 6) AS sharp FROM ratings""")
def sharpen(t):
    return t.ratings.select("userId", "itemId", s.r6(s.sharpen(F.col("rating") / 5)).alias("sharp"))


@query("g7_split_trim", "items", """SELECT itemId, CASE WHEN genres LIKE '(%' THEN 0 ELSE len(string_split(genres, '|')) END AS n,
    CASE WHEN genres LIKE '(%' THEN '' ELSE trim(split_part(genres, '|', 1)) END AS first FROM items""")
def split_trim(t):
    genres = s.genre_array(F.concat(F.lit(" "), F.regexp_replace("genres", r"\|", " | ")))
    return t.items.select("itemId", F.size(genres).cast("long").alias("n"),
                          F.coalesce(F.try_element_at(genres, F.lit(1)), F.lit("")).alias("first"))


@query("g8_estimate_text", "ratings", """SELECT userId, itemId, TRY_CAST(substring(regexp_extract('user: x est = ' ||
    CAST(rating AS VARCHAR) || '125 {}', 'est = ([0-9]+\\.[0-9]+)', 1), 1, 4) AS DOUBLE) AS est FROM ratings""")
def estimate_text(t):
    text = F.concat(F.lit("user: x est = "), F.col("rating").cast("string"), F.lit("125 {}"))
    return t.ratings.select("userId", "itemId", s.estimate_from_text(text).alias("est"))


@query("g9_bits_to_number", "items", """SELECT itemId, bits,
    CAST(bits[1] = '1' AS BIGINT) * 4 + CAST(bits[2] = '1' AS BIGINT) * 2 + CAST(bits[3] = '1' AS BIGINT) AS number FROM (
    SELECT itemId, CASE WHEN contains(genres, 'PROMO') THEN '1' ELSE '0' END || CASE WHEN contains(genres, 'ring') THEN '1'
    ELSE '0' END || CASE WHEN contains(genres, 'gear') THEN '1' ELSE '0' END AS bits FROM items)""")
def bits_to_number(t):
    bits = F.concat(*[F.when(F.col("genres").contains(g), "1").otherwise("0") for g in ("PROMO", "ring", "gear")])
    return t.items.select("itemId", bits.alias("bits"), s.bits_to_number(bits).alias("number"))


@query("g11_manhattan", "fr", "SELECT userId, itemId, round(abs(r_low) + abs(r_medium) + abs(r_high), 6) AS size FROM fr")
def manhattan(t):
    profile = t.stored.select("userId", "itemId", *fuz.rating_profile(fuz.fitted(t.stored)))
    size = s.manhattan([F.col(f"r_{x}") for x in fuz.LABELS], [F.lit(0.0)] * 3)
    return profile.select("userId", "itemId", s.r6(size).alias("size"))


@query("g12_pearson_distance", "ratings", "SELECT userId, CASE WHEN stddev_pop(rating) * stddev_pop(ts) > 0 THEN round(1 - covar_pop(rating, ts) / (stddev_pop(rating) * stddev_pop(ts)), 6) END AS distance FROM ratings GROUP BY userId HAVING count(*) > 2")
def pearson_distance(t):
    found = t.ratings.groupBy("userId").agg(
        s.r6(s.pearson_distance(F.col("rating"), F.col("ts"))).alias("distance"), F.count(F.lit(1)).alias("n")
    )
    return found.where("n > 2").drop("n")


@query("g13_linear_grid", "ratings", """SELECT cut, count(*) AS n FROM (SELECT unnest([0.5, 1.625, 2.75, 3.875, 5.0])::DOUBLE AS cut)
    JOIN ratings ON rating >= cut GROUP BY cut""")
def linear_grid(t):
    """Ratings at or above each of five evenly spaced cuts."""
    cuts = t.ratings.select("rating", F.explode(s.grid(0.5, 5.0, 5)).alias("cut"))
    return agg.count_by(cuts.where("rating >= cut"), "cut")
