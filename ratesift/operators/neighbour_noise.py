"""Noise by prediction: a rating far from what its user's neighbours suggest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ratesift.functions.scalars import flag, half_even, ratio, split_key
from ratesift.operators.blocks import BlockPlan, pair_statistics, weighted_means
from ratesift.operators.ordering import hashed_rank, top_per_group


@dataclass(frozen=True)
class NeighbourNoise:
    """Estimates stay within ``r_min`` and ``r_max``, or else within the training ratings."""

    k: int = 40
    similarity: str = "msd"
    threshold: float = 0.05
    r_min: float | None = None
    r_max: float | None = None
    block: int = 2048


def stratified_split(ratings: DataFrame, ratio_train: float, seed: int = 42) -> DataFrame:
    """Append is_train: the first half-even share of each user's ratings by the portable key."""
    key = split_key(F.col("userId"), F.col("itemId"), seed)
    ranked = hashed_rank(ratings, ["userId"], key, ["itemId"], "_r", "_n")
    return ranked.withColumn("is_train", flag(F.col("_r") <= half_even(F.col("_n") * ratio_train))).drop("_r", "_n")


def _facts(ratings: DataFrame, value: str = "rating") -> DataFrame:
    return ratings.select(F.col("userId").alias("key"), F.col("itemId").alias("dim"), F.col(value).alias("val"))


def co_rating_summary(ratings: DataFrame, block: int = 2048) -> DataFrame:
    """Per user: other users sharing an item, shared items over all of them, and the most shared with one."""
    stats = pair_statistics(_facts(ratings), BlockPlan(reduce="summary", block=block))
    return stats.groupBy(F.col("key").alias("userId")).agg(
        F.sum("neighbours").alias("neighbours"), F.sum("shared").alias("shared"), F.max("best_shared").alias("best_shared")
    )


def top_neighbours(ratings: DataFrame, k: int = 10, similarity: str = "msd", block: int = 2048) -> DataFrame:
    """The k most similar users of each user, ties by id."""
    stats = pair_statistics(_facts(ratings), BlockPlan(similarity=similarity, reduce="neighbours", k=k, block=block))
    named = stats.select(F.col("key").alias("userId"), F.col("other").alias("neighbour"), "sim", "shared")
    return top_per_group(named, ["userId"], [F.desc("sim"), F.asc("neighbour")], k)


def knn_with_means(train: DataFrame, test: DataFrame, params: NeighbourNoise = NeighbourNoise()) -> DataFrame:
    """Append est to the test ratings: user mean plus the similarity-weighted deviation of the k best neighbours."""
    means = train.groupBy("userId").agg(F.avg("rating").alias("mean"))
    deviations = train.join(means, "userId").withColumn("dev", F.col("rating") - F.col("mean"))
    shift = weighted_means(
        _facts(train),
        BlockPlan(similarity=params.similarity, k=params.k, block=params.block),
        _facts(test),
        _facts(deviations, "dev"),
    ).select(F.col("key").alias("userId"), F.col("dim").alias("itemId"), F.col("mean").alias("shift"))
    known_items = train.select("itemId").distinct().withColumn("known", F.lit(True))
    overall = train.agg(F.avg("rating")).scalar()
    raw = F.when(F.col("mean").isNull() | F.col("known").isNull(), overall).otherwise(
        F.col("mean") + F.coalesce("shift", F.lit(0.0))
    )
    scale = train.agg(F.struct(F.min("rating").alias("low"), F.max("rating").alias("high"))).scalar()
    low = scale["low"] if params.r_min is None else F.lit(params.r_min)
    high = scale["high"] if params.r_max is None else F.lit(params.r_max)
    clipped = F.least(F.greatest(raw, low), high)
    return (
        test.join(means, "userId", "left")
        .join(known_items, "itemId", "left")
        .join(shift, ["userId", "itemId"], "left")
        .withColumn("est", F.round(clipped, 9))
        .drop("mean", "known", "shift")
    )


def two_decimals(est):
    return half_even(est * 100) / 100


def flag_neighbour_noise(predictions: DataFrame, test: DataFrame, threshold: float = 0.05, name: str = "nf3") -> DataFrame:
    """Append the flag: the two-decimal estimate misses the rating by more than a share of the test ratings' range.

    The range comes from the plain test ratings, so that it does not repeat the prediction.
    """
    spread = test.agg(F.max("rating") - F.min("rating")).scalar()
    miss = ratio(F.abs(F.col("rating") - two_decimals(F.col("est"))), spread)
    return predictions.withColumn(name, flag(miss > threshold))
