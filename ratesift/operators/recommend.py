"""Recommendations, graph propagation and interaction sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratesift.operators.metrics import improved_share, improvement, ranking_metrics, user_hits
from ratesift.operators.ordering import dense_index, global_rank, group_rank, top_per_group
from ratesift.operators.vectors import VectorPlan, bounded_top_k
from ratesift.session import durable

MAX_GROUPS = 1000


def popular_items(train: DataFrame) -> DataFrame:
    """Items by number of ratings: itemId, prediction, place (1-based, ties by id)."""
    counts = train.groupBy("itemId").agg(F.count(F.lit(1)).cast("double").alias("prediction"))
    return global_rank(counts, [F.desc("prediction"), F.asc("itemId")], "place")


def recommend_popular(train: DataFrame, k: int = 10) -> DataFrame:
    """The k most popular items each user has not rated.

    A user who rated d items finds them within the first k + d places, so k + d candidates per user, joined by
    place, are complete.
    """
    depth = train.groupBy("userId").agg((F.count(F.lit(1)) + k).alias("depth"))
    places = depth.select("userId", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))).alias("place"))
    unseen = places.join(popular_items(train), "place").join(train.select("userId", "itemId"), ["userId", "itemId"], "left_anti")
    return top_per_group(unseen, ["userId"], [F.asc("place")], k).select("userId", "itemId", "prediction", "rank")


def implicit_edges(ratings: DataFrame) -> DataFrame:
    """Positive ratings as edges between dense indexes."""
    liked = ratings.where("rating > 0").select("userId", "itemId")
    return liked.join(dense_index(liked, "userId", "u"), "userId").join(dense_index(liked, "itemId", "i"), "itemId")


def normalized_adjacency(edges: DataFrame) -> DataFrame:
    """Edges (userId, itemId) weighted 1 / sqrt(degree of the user * degree of the item)."""
    users = edges.groupBy("userId").agg(F.count(F.lit(1)).alias("du"))
    items = edges.groupBy("itemId").agg(F.count(F.lit(1)).alias("di"))
    weight = 1 / F.sqrt((F.col("du") * F.col("di")).cast("double"))
    return edges.join(users, "userId").join(items, "itemId").select("userId", "itemId", weight.alias("weight"))


def propagate(weighted: DataFrame, vectors: DataFrame, dims: int, layers: int = 3) -> DataFrame:
    """Mean over layers 0..L of the vectors passed along the bipartite graph.

    ``vectors`` holds (kind 'u' or 'i', id, vec). Each layer is one join and one aggregate with a sum per
    dimension, combined before the shuffle; each is written out, because the mean reads all of them.
    """
    links = durable(
        weighted.select(F.lit("u").alias("kind"), F.col("userId").alias("id"), F.lit("i").alias("to_kind"), F.col("itemId").alias("to_id"), "weight")
        .unionByName(weighted.select(F.lit("i").alias("kind"), F.col("itemId").alias("id"), F.lit("u").alias("to_kind"), F.col("userId").alias("to_id"), "weight")),
        "links",
    )
    layer, all_layers = vectors.select("kind", "id", "vec"), vectors.select("kind", "id", "vec")
    sums = [F.sum(F.col("weight") * F.col("vec")[d]).alias(f"d{d}") for d in range(dims)]
    for _ in range(layers):
        passed = links.join(layer, ["kind", "id"]).groupBy("to_kind", "to_id").agg(*sums)
        layer = durable(passed.select(
            F.col("to_kind").alias("kind"), F.col("to_id").alias("id"), F.array(*[f"d{d}" for d in range(dims)]).alias("vec")
        ), "layer")
        all_layers = all_layers.unionByName(layer)
    means = [(F.sum(F.col("vec")[d]) / (layers + 1)).alias(f"d{d}") for d in range(dims)]
    return all_layers.groupBy("kind", "id").agg(*means)


@dataclass(frozen=True)
class Factors:
    """A factor model over dense numbers, and the ids that they stand for."""

    model: ALSModel
    users: DataFrame  # userId, u
    items: DataFrame  # itemId, i


def fit_factors(train: DataFrame, rank: int = 16, iterations: int = 5, seed: int = 42) -> Factors:
    """Implicit factors. The model takes 32-bit numbers only, so ids of any size are numbered densely first."""
    users = durable(dense_index(train, "userId", "u"), "users")
    items = durable(dense_index(train, "itemId", "i"), "items")
    als = ALS(
        userCol="u", itemCol="i", ratingCol="rating", rank=rank, maxIter=iterations, seed=seed,
        implicitPrefs=True, coldStartStrategy="drop",
    )
    numbered = train.join(users, "userId").join(items, "itemId")
    return Factors(als.fit(numbered.select(F.col("u").cast("int"), F.col("i").cast("int"), "rating")), users, items)


def factor_vectors(fitted: Factors) -> DataFrame:
    """(kind 'u' or 'i', id, vec)"""
    def side(kind: str, factors: DataFrame, ids: DataFrame, key: str, number: str) -> DataFrame:
        vec = F.col("features").cast("array<double>").alias("vec")
        named = factors.join(ids, factors["id"] == ids[number])
        return named.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), vec)

    return side("u", fitted.model.userFactors, fitted.users, "userId", "u").unionByName(
        side("i", fitted.model.itemFactors, fitted.items, "itemId", "i")
    )


def negative_draws(positives: DataFrame, catalogue: DataFrame, seen: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n unseen items per positive (instance, userId, itemId).

    Draws are places among the user's unseen items, spread evenly from a keyed start. The place of an unseen
    item plus the number of seen items at or before it is its catalogue index; that number comes from a running
    count per (user, index block), so no candidates are generated and nothing is rejected.
    """
    index = durable(dense_index(catalogue, "itemId", "idx"), "catalogue")
    size = index.agg(F.count(F.lit(1))).scalar()
    marks = seen.select("userId", "itemId").distinct().join(index, "itemId").select("userId", "idx")
    # x_j - j for the j-th seen index: seen items are passed once this is at most the place.
    ranked = durable(group_rank(marks, ["userId"], [F.asc("idx")], "j", "n_seen"), "marks")
    thresholds = ranked.select("userId", (F.col("idx") - F.col("j") + 1).alias("value"))
    counts = ranked.select("userId", "n_seen").distinct()
    free = size - F.coalesce("n_seen", F.lit(0))
    start = F.col("userId") * 7919 + F.col("itemId") * 104729 + F.col("instance") * 31 + seed
    drawn = (
        positives.select("instance", "userId", "itemId")
        .join(counts, "userId", "left")
        .withColumn("free", free)
        .where("free > 0")
        .withColumn("take", F.least(F.lit(n).cast("long"), F.col("free")))
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
        .withColumn("step", F.greatest(F.lit(1).cast("long"), F.floor(F.col("free") / n)))
        .withColumn("value", (start + F.col("draw") * F.col("step")) % F.col("free"))
        .select("instance", "userId", "draw", "value")
    )
    placed = _count_at_most(thresholds, drawn, "userId", "value", "passed")
    return placed.withColumn("idx", F.col("value") + F.col("passed")).join(index, "idx").select(
        "instance", "userId", "draw", "itemId"
    )


def _count_at_most(facts: DataFrame, asked: DataFrame, key: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """For each asked (key, value): facts of the key with a value at most as large, counted block by block."""
    block = F.floor(F.col(value) / width)
    counted = facts.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", block)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    questions = asked.select(key, value).distinct().withColumn("_b", block)
    all_rows = counted.unionByName(questions.withColumn("_n", F.lit(0).cast("long")))
    offsets = all_rows.groupBy(key, "_b").agg(F.sum("_n").alias("_s")).select(
        key, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(key, "_b").orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    found = (
        all_rows.withColumn("_in", F.sum("_n").over(inside))
        .join(offsets, [key, "_b"])
        .groupBy(key, value)
        .agg(F.max(F.col("_in") + F.col("_off")).alias(name))
    )
    return asked.join(found, [key, value])


def histories(events: DataFrame, length: int = 50, chunk: int = 1000) -> DataFrame:
    """Items, categories and times before each event, at most ``length`` of each, as comma lists.

    A user's events are cut into chunks of ``chunk`` that repeat the last ``length`` events of the chunk before
    them, so the window of a busy user is spread over tasks.
    """
    ranked = group_rank(events, ["userId"], [F.asc("ts"), F.asc("event_id")], "pos", "n")
    home = F.floor((F.col("pos") - 1) / chunk)
    spill = F.floor((F.col("pos") - 1 + length) / chunk)
    copies = ranked.withColumn("home", home).withColumn("chunk", F.explode(F.array_distinct(F.array(home, spill))))
    last = Window.partitionBy("userId", "chunk").orderBy("pos").rowsBetween(-length, -1)

    def listed(column: str) -> Column:
        return F.array_join(F.collect_list(F.col(column).cast("string")).over(last), ",").alias(f"history_{column}")

    return copies.select(
        "event_id", "userId", "itemId", "category", "ts", "home", "chunk", "pos",
        listed("itemId"), listed("category"), listed("ts"),
    ).where("chunk = home").drop("home", "chunk")


def vocabulary(train: DataFrame, column: str) -> DataFrame:
    """Training values numbered from 1 in order; join misses become 0 with ``encode``."""
    return dense_index(train, column, "_z").select(column, (F.col("_z") + 1).alias(f"{column}_idx"))


def encode(df: DataFrame, vocab: DataFrame, column: str) -> DataFrame:
    name = f"{column}_idx"
    return df.join(vocab, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def top_k_products(left: DataFrame, right: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """The k right vectors with the largest inner product per left vector; ``seen`` (id, other) pairs are left out."""
    return bounded_top_k(left, right, VectorPlan(k=k, metric="dot"), seen)


def recommend_by_group(train: DataFrame, test: DataFrame, clusters: DataFrame, k: int = 10) -> DataFrame:
    """Per cluster: fit on its users' ratings, recommend to them, evaluate on their test ratings.

    Every cluster costs a fit, so more than MAX_GROUPS clusters are refused.
    """
    groups = [r.cluster for r in clusters.select("cluster").distinct().orderBy("cluster").limit(MAX_GROUPS + 1).collect()]
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} clusters")
    results = []
    train, test = durable(train.join(clusters, "userId")), durable(test.join(clusters, "userId"))
    for group in groups:
        own = train.where(F.col("cluster") == group).drop("cluster")
        truth = test.where(F.col("cluster") == group).drop("cluster")
        metrics = ranking_metrics(factor_hits(own, truth, k), k)
        results.append(metrics.select(F.lit(group).alias("cluster"), "ndcg", "precision", "recall", "map", "n_users"))
    return reduce(DataFrame.unionByName, results)


def factor_hits(train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """Per-user hits of a factor model trained on ``train``."""
    vectors = durable(factor_vectors(fit_factors(train)), "factors")
    seen = train.select(F.col("userId").alias("id"), F.col("itemId").alias("other"))
    recs = top_k_products(vectors.where("kind = 'u'").select("id", "vec"), vectors.where("kind = 'i'").select("id", "vec"), k, seen)
    return user_hits(recs.select(F.col("id").alias("userId"), F.col("other").alias("itemId"), "rank"), test, k)


def cut_sweep(train: DataFrame, test: DataFrame, vectors: DataFrame, cuts: tuple[int, ...], regroup, goal: float = 80.0) -> DataFrame:
    """Per cut: share of users whose nDCG improves when every group gets its own model; stops once the goal is met."""
    def gain(hits: DataFrame) -> DataFrame:
        return hits.select("userId", (F.col("dcg") / F.col("idcg")).alias("ndcg"))

    base = durable(gain(factor_hits(train, test)), "base")
    outcomes = []
    for k in cuts:
        groups = regroup(vectors, (k,)).select("userId", F.col(f"group_{k}").alias("cluster"))
        own, truth = durable(train.join(groups, "userId"), "own"), durable(test.join(groups, "userId"), "truth")
        parts = [
            gain(factor_hits(own.where(F.col("cluster") == g).drop("cluster"), truth.where(F.col("cluster") == g).drop("cluster")))
            for g in range(k)
        ]
        compared = improvement(base, reduce(DataFrame.unionByName, parts), "ndcg")
        outcome = durable(improved_share(compared, goal).withColumn("cut", F.lit(k)), "cut")
        outcomes.append(outcome)
        if outcome.first()["reached"] == 1:
            break
    return reduce(DataFrame.unionByName, outcomes).select("cut", "percent_improved", "reached")
