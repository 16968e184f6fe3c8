"""Ranking, error, diversity and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratesift.functions.scalars import flag, genre_array, ratio
from ratesift.operators.blocks import BlockPlan, pair_statistics
from ratesift.operators.coherence_noise import by_genre
from ratesift.operators.ordering import top_per_group
from ratesift.session import by_shuffle, durable

# Relevance cut of precision/recall on predicted ratings, redundancy discount of the diversity metric.
RELEVANT = 3.5
ALPHA = 0.5


def rank_predictions(predictions: DataFrame, k: int, score: str = "prediction") -> DataFrame:
    return top_per_group(predictions, ["userId"], [F.desc(score), F.asc("itemId")], k)


def precision_recall_at(predictions: DataFrame, k: int = 10, threshold: float = RELEVANT) -> DataFrame:
    """Per user, over the k highest estimates; relevant means a rating at or above the threshold."""
    top = rank_predictions(predictions, k, "est").groupBy("userId").agg(
        F.count_if(F.col("est") >= threshold).alias("recommended"),
        F.count_if((F.col("est") >= threshold) & (F.col("rating") >= threshold)).alias("both"),
    )
    relevant = predictions.groupBy("userId").agg(F.count_if(F.col("rating") >= threshold).alias("relevant"))
    return relevant.join(top, "userId").select(
        "userId",
        ratio(F.col("both"), F.col("recommended")).alias("precision"),
        ratio(F.col("both"), F.col("relevant")).alias("recall"),
    )


def ideal_dcg(n: Column) -> Column:
    terms = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, r: acc + 1 / F.log1p(r))


def user_hits(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Per user with recommendations and true ratings: hit, actual, dcg, idcg and average precision."""
    top = by_shuffle(recs.where(F.col("rank") <= k).select("userId", "itemId", "rank"))
    # At most k rows per user reach this window.
    order = F.row_number().over(Window.partitionBy("userId").orderBy("rank"))
    hits = (
        top.join(truth.select("userId", "itemId"), ["userId", "itemId"])
        .withColumn("nth", order)
        .groupBy("userId")
        .agg(
            F.count(F.lit(1)).alias("hit"),
            F.sum(1 / F.log1p("rank")).alias("dcg"),
            F.sum(F.col("nth") / F.col("rank")).alias("ap_sum"),
        )
    )
    actual = truth.groupBy("userId").agg(F.count(F.lit(1)).alias("actual"))
    both = actual.join(top.select("userId").distinct(), "userId", "left_semi")
    zero = F.lit(0.0)
    return both.join(hits, "userId", "left").select(
        "userId",
        F.coalesce("hit", F.lit(0)).cast("long").alias("hit"),
        "actual",
        F.coalesce("dcg", zero).alias("dcg"),
        ideal_dcg(F.least("actual", F.lit(k))).alias("idcg"),
        (F.coalesce("ap_sum", zero) / F.col("actual")).alias("ap"),
    )


def ranking_metrics(per_user: DataFrame, k: int = 10) -> DataFrame:
    """nDCG, precision, recall and MAP, averaged over all users on both sides."""
    return per_user.agg(
        F.avg(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        F.avg(F.col("hit") / k).alias("precision"),
        F.avg(F.col("hit") / F.col("actual")).alias("recall"),
        F.avg("ap").alias("map"),
        F.count(F.lit(1)).alias("n_users"),
    )


def rating_errors(predictions: DataFrame) -> DataFrame:
    gap = F.col("rating") - F.col("est")
    return predictions.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def rating_levels(ratings: DataFrame, most: int = 1000) -> list[float]:
    """The distinct ratings in order; a scale of more than ``most`` levels is refused."""
    found = ratings.where("rating IS NOT NULL").select("rating").distinct().orderBy("rating").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} distinct ratings")
    return [r.rating for r in found]


def concordance(predictions: DataFrame, levels: list[float], digits: int = 6) -> DataFrame:
    """Fraction of concordant pairs, without forming pairs; ``levels`` are all ratings that occur (``rating_levels``).

    Rows are counted per (user, estimate, rating level) first. A running count per level, in order of the
    estimate, then tells how many lower-rated rows also have a lower estimate. A user contributes at most as
    many rows as there are distinct estimates on the digit grid of the rating scale.
    """
    e = F.round(F.col("est") * 10**digits).cast("long")
    names = [f"l{i}" for i in range(len(levels))]
    counts = predictions.groupBy("userId", e.alias("e")).agg(
        *[F.count_if(F.col("rating") == v).alias(n) for n, v in zip(names, levels, strict=True)]
    )
    below = Window.partitionBy("userId").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.select("userId", *names, *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"b_{n}") for n in names])
    lower, concordant = F.lit(0), F.lit(0)
    for n in names:
        concordant = concordant + F.col(n) * lower
        lower = lower + F.col(f"b_{n}")
    per_user = running.groupBy("userId").agg(F.sum(concordant).alias("concordant"), *[F.sum(n).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0))
    same = sum((F.col(n) * F.col(n) for n in names), F.lit(0))
    pairs = per_user.select("userId", "concordant", ((total * total - same) / 2).alias("pairs"))
    return pairs.agg(ratio(F.sum("concordant"), F.sum("pairs")).alias("fcp"))


def user_mae(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("userId").agg(F.avg(F.abs(F.col("rating") - F.col("est"))).alias("mae"))


def neighbourhood_mae(predictions: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Mean error over the neighbours of each user."""
    errors = user_mae(predictions).withColumnRenamed("userId", "neighbour")
    return neighbours.join(errors, "neighbour").groupBy("userId").agg(F.avg("mae").alias("neighbour_mae"))


def coverage(recs: DataFrame, train: DataFrame) -> DataFrame:
    known = train.agg(F.count_distinct("itemId")).scalar()
    return recs.agg((F.count_distinct("itemId") / known).alias("coverage"))


def serendipity(recs: DataFrame, train: DataFrame, block: int = 2048) -> DataFrame:
    """Per recommended (user, item): one minus the mean co-occurrence similarity to the user's train items.

    similarity(i, j) = users of both / sqrt(users of i * users of j). Similarities live inside item block
    pairs; only their sum per recommendation leaves a task.
    """
    popularity = train.groupBy("itemId").agg(F.count(F.lit(1)).alias("n"))
    facts = train.join(popularity, "itemId").select(
        F.col("itemId").alias("key"), F.col("userId").alias("dim"), F.col("n").alias("val")
    )
    recs = by_shuffle(recs)
    asked = recs.select(F.col("itemId").alias("key"), F.col("userId").alias("dim"), F.lit(0.0).alias("val"))
    sums = pair_statistics(facts, BlockPlan(similarity="cosine", reduce="sum", block=block), asked, facts)
    total = sums.groupBy(F.col("dim").alias("userId"), F.col("key").alias("itemId")).agg(F.sum("sim").alias("total"))
    history = train.groupBy("userId").agg(F.count(F.lit(1)).alias("n_train"))
    unexpected = 1 - ratio(F.coalesce("total", F.lit(0.0)), F.col("n_train"))
    return (
        recs.join(total, ["userId", "itemId"], "left")
        .join(history, "userId", "left")
        .select("userId", "itemId", unexpected.alias("serendipity"))
    )


def user_serendipity(scored: DataFrame) -> DataFrame:
    return scored.groupBy("userId").agg(F.avg("serendipity").alias("serendipity"))


def genre_likelihood(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each genre among a user's genre assignments."""
    counts = by_genre(ratings, items).groupBy("userId", "genre").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("userId").agg(F.sum("n").alias("total"))
    return counts.join(totals, "userId").select("userId", "genre", (F.col("n") / F.col("total")).alias("likelihood"))


def _liked(likelihood: DataFrame) -> DataFrame:
    """A user's likelihoods as one map; its size is bounded by the genres of the catalogue."""
    pairs = F.collect_list(F.struct("genre", "likelihood"))
    return likelihood.groupBy("userId").agg(F.map_from_entries(pairs).alias("liked"))


def diversity_dcg(ranked: DataFrame, items: DataFrame, likelihood: DataFrame, k: int = 5, alpha: float = ALPHA) -> DataFrame:
    """DCG of a ranking (userId, itemId, rank, hit): a hit gains its genres' likelihoods, halved per repetition."""
    genres = items.select("itemId", F.explode(genre_array(F.col("genres"))).alias("genre"))
    # At most k ranked items per user enter the window.
    before = Window.partitionBy("userId", "genre").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    exploded = ranked.where(F.col("rank") <= k).join(genres, "itemId").withColumn("seen", F.count(F.lit(1)).over(before))
    gain = F.col("hit") * F.col("likelihood") * F.pow(F.lit(1 - alpha), F.col("seen")) / F.log2(F.col("rank") + 1)
    return exploded.join(likelihood, ["userId", "genre"]).groupBy("userId").agg(F.sum(gain).alias("dcg"))


def ideal_diversity_dcg(truth: DataFrame, items: DataFrame, likelihood: DataFrame, k: int = 5, alpha: float = ALPHA) -> DataFrame:
    """DCG of the greedy ideal ranking of each user's true items.

    Only an item's genre set matters, so the k lowest ids per (user, genre set) are kept: what a user brings
    to the k greedy rounds is bounded by the genre sets of the catalogue.
    """
    sets = items.select("itemId", F.array_join(genre_array(F.col("genres")), "|").alias("gset"))
    kept = top_per_group(truth.join(sets, "itemId"), ["userId", "gset"], [F.asc("itemId")], k, "_r")
    entry = F.struct(F.col("itemId"), F.when(F.col("gset") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("gset", r"\|")).alias("genres"))
    pools = kept.groupBy("userId").agg(F.collect_list(entry).alias("pool")).join(_liked(likelihood), "userId")

    def gain(item: Column, used: Column) -> Column:
        def term(g: Column) -> Column:
            repeats = F.size(F.filter(used, lambda u: u == g))
            return F.coalesce(F.try_element_at(F.col("liked"), g), F.lit(0.0)) * F.pow(F.lit(1 - alpha), repeats)

        return F.round(F.aggregate(item["genres"], F.lit(0.0), lambda acc, g: acc + term(g)), 9)

    def round_(acc: Column, rank: Column) -> Column:
        # Best gain first, lowest id among equals.
        scored = F.transform(acc["pool"], lambda x: F.struct(
            gain(x, acc["used"]).alias("gain"), (-x["itemId"]).alias("neg"), x["genres"].alias("genres")))
        best = F.array_max(scored)
        return F.when(F.size(acc["pool"]) == 0, acc).otherwise(F.struct(
            (acc["dcg"] + best["gain"] / F.log2(rank + 1)).alias("dcg"),
            F.concat(acc["used"], best["genres"]).alias("used"),
            F.filter(acc["pool"], lambda x: x["itemId"] != -best["neg"]).alias("pool"),
        ))

    start = F.struct(F.lit(0.0).alias("dcg"), F.array().cast("array<string>").alias("used"), F.col("pool").alias("pool"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, round_, lambda acc: acc["dcg"])
    return pools.select("userId", done.alias("idcg"))


def diversity_ndcg(recs: DataFrame, truth: DataFrame, ratings: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """Per user with more than k true ratings: dcg and idcg of the diversity metric."""
    likelihood = durable(genre_likelihood(ratings, items), "likelihood")
    enough = truth.groupBy("userId").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("userId")
    wanted = durable(truth.join(enough, "userId", "left_semi").select("userId", "itemId"), "wanted")
    hits = wanted.withColumn("hit", F.lit(1))
    ranked = by_shuffle(recs.select("userId", "itemId", "rank")).join(hits, ["userId", "itemId"], "left").fillna(0, ["hit"])
    dcg = diversity_dcg(ranked, items, likelihood, k)
    ideal = ideal_diversity_dcg(wanted, items, likelihood, k)
    return enough.join(dcg, "userId", "left").join(ideal, "userId", "left").fillna(0.0, ["dcg", "idcg"])


def confusion(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and, per class, precision and recall."""
    cells = df.groupBy(F.col(truth).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    # Two classes: a handful of rows from here on.
    total = cells.agg((F.sum(hit) / F.sum("n")).alias("accuracy"))
    lines = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("cls"), hit.alias("hit"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("claimed")),
    )).alias("x")).select("x.*")
    per_class = lines.groupBy("cls").agg(F.sum("hit").alias("h"), F.sum("actual").alias("a"), F.sum("claimed").alias("c"))
    return per_class.select(
        "cls", ratio(F.col("h"), F.col("c")).alias("precision"), ratio(F.col("h"), F.col("a")).alias("recall"),
        total.scalar().alias("accuracy"),
    )


def auc(scored: DataFrame, keys: list[str] | None = None, label: str = "label", score: str = "score", digits: int = 6) -> DataFrame:
    """Exact area under the curve on the score grid, ties counted half; per group when keys are given.

    Scores in [0, 1] are counted per grid value first, which bounds the rows of the running sum.
    """
    keys = keys or []
    counts = scored.groupBy(*keys, F.round(F.col(score), digits).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    below = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    wins = counts.withColumn("won", F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2))
    return wins.groupBy(*keys).agg(
        F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        (F.sum("pos") + F.sum("neg")).alias("size"),
    )


def group_auc(scored: DataFrame, key: str) -> DataFrame:
    """AUC per group, averaged by group size over groups that hold both classes."""
    per_group = auc(scored, [key]).where("auc IS NOT NULL")
    return per_group.agg((F.sum(F.col("auc") * F.col("size")) / F.sum("size")).alias("group_auc"))


def instance_ndcg(scored: DataFrame, instance: str, k: int) -> DataFrame:
    """Mean nDCG@k over instances holding one positive among their negatives; ties by item id."""
    order = Window.partitionBy(instance).orderBy(F.desc("score"), F.asc("itemId"))
    placed = scored.withColumn("rank", F.row_number().over(order)).where("label = 1")
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return placed.agg(F.avg(gain).alias("ndcg"))


def improvement(base: DataFrame, new: DataFrame, metric: str) -> DataFrame:
    """Per user the metric before and after, with a flag for users that improved."""
    before = base.select("userId", F.col(metric).alias("base"))
    after = new.select("userId", F.col(metric).alias("new"))
    return before.join(after, "userId").withColumn("improved", flag(F.col("new") > F.col("base")))


def improved_share(compared: DataFrame, goal: float = 80.0) -> DataFrame:
    share = F.avg("improved") * 100
    return compared.agg(share.alias("percent_improved"), flag(share > goal).alias("reached"))
