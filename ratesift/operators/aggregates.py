"""Grouped statistics of rating tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratesift.operators.coherence_noise import by_genre
from ratesift.operators.relational import epoch_date


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def polarity_counts(ratings: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Per user: ratings, those above the threshold, those at or below it."""
    r = F.col("rating")
    return ratings.groupBy("userId").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(r > threshold).alias("positive"),
        F.count_if(r <= threshold).alias("negative"),
    )


def genre_sums(ratings: DataFrame, items: DataFrame) -> DataFrame:
    return by_genre(ratings, items).groupBy("userId", "genre").agg(F.sum("rating").alias("genre_sum"))


def daily_activity(ratings: DataFrame) -> DataFrame:
    """Ratings per user and day, with the number of days the user was active."""
    daily = ratings.groupBy("userId", epoch_date().alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = daily.groupBy("userId").agg(F.count(F.lit(1)).alias("active_days"))
    return daily.join(days, "userId")


def most_rated(ratings: DataFrame, n: int) -> DataFrame:
    return count_by(ratings, "itemId").orderBy(F.desc("n"), "itemId").limit(n)


def size_report(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count_distinct("userId").alias("users"),
        F.count_distinct("itemId").alias("items"),
        F.count(F.lit(1)).alias("n_rows"),
    )
