"""Noise by user and item categories: a rating that contradicts both its user's and its item's habit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ratesift.functions.scalars import flag, half_even

# Category names in the order they are tested.
USER_CATEGORIES = ("Critical", "Average", "Benevolent", "Variable")
ITEM_CATEGORIES = ("Weakly-preferred", "Averagely-preferred", "Strongly-preferred", "Variably-preferred")


@dataclass(frozen=True)
class CategoryNoise:
    """``mode='paper'`` reads the average clause as r < k or r >= v; ``'reference'`` as v <= r < k."""

    mode: str = "reference"
    k: float | None = None
    v: float | None = None


def thresholds(ratings: DataFrame) -> DataFrame:
    """One row with the scale and the two cuts, a third of the range (rounded half-even) from each end."""
    third = half_even((F.max("rating") - F.min("rating")) / 3)
    return ratings.agg(
        F.min("rating").alias("r_min"),
        F.max("rating").alias("r_max"),
        (F.min("rating") + third).alias("k"),
        (F.max("rating") - third).alias("v"),
    )


def cuts(ratings: DataFrame, params: CategoryNoise = CategoryNoise()) -> tuple[Column, Column]:
    """The cuts as columns: given numbers, or scalar subqueries that Spark evaluates once."""
    if params.k is not None and params.v is not None:
        return F.lit(params.k), F.lit(params.v)
    found = thresholds(ratings)
    return found.select("k").scalar(), found.select("v").scalar()


def rating_group(rating: Column, k: Column, v: Column) -> Column:
    return F.when(rating < k, "Wu").when(rating < v, "Au").when(rating >= v, "Su")


def group_counts(ratings: DataFrame, key: str, k: Column, v: Column) -> DataFrame:
    """Ratings per key in the weak, average and strong group; absent groups count 0."""
    r = F.col("rating")
    return ratings.groupBy(key).agg(
        F.count_if(r < k).alias("w"), F.count_if((r >= k) & (r < v)).alias("a"), F.count_if(r >= v).alias("s")
    )


def category(names: tuple[str, str, str, str]) -> Column:
    """First habit that outweighs the two others; ties go to the earlier one."""
    w, a, s = F.col("w"), F.col("a"), F.col("s")
    return F.when(w >= a + s, names[0]).when(a >= w + s, names[1]).when(s >= w + a, names[2]).otherwise(names[3])


def user_categories(ratings: DataFrame, k: Column, v: Column) -> DataFrame:
    return group_counts(ratings, "userId", k, v).select("userId", category(USER_CATEGORIES).alias("user_cat"))


def item_categories(ratings: DataFrame, k: Column, v: Column) -> DataFrame:
    return group_counts(ratings, "itemId", k, v).select("itemId", category(ITEM_CATEGORIES).alias("item_cat"))


def flag_category_noise(ratings: DataFrame, params: CategoryNoise = CategoryNoise()) -> DataFrame:
    """Append rating_group, user_cat, item_cat and nf1."""
    k, v = cuts(ratings, params)
    r, user, item = F.col("rating"), F.col("user_cat"), F.col("item_cat")
    outside = (r < k) | (r >= v) if params.mode == "paper" else (r >= v) & (r < k)
    noisy = (
        ((user == USER_CATEGORIES[0]) & (item == ITEM_CATEGORIES[0]) & (r >= k))
        | ((user == USER_CATEGORIES[1]) & (item == ITEM_CATEGORIES[1]) & outside)
        | ((user == USER_CATEGORIES[2]) & (item == ITEM_CATEGORIES[2]) & (r < v))
    )
    return (
        ratings.join(user_categories(ratings, k, v), "userId")
        .join(item_categories(ratings, k, v), "itemId", "left")
        .withColumn("rating_group", rating_group(r, k, v))
        .withColumn("nf1", flag(noisy))
    )
