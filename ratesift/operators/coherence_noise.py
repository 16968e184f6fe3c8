"""Noise by genre coherence: a rating far from its user's mean in the genres of its item."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ratesift.functions.scalars import flag, genre_array, r6
from ratesift.operators.ordering import group_medians, quantiles
from ratesift.session import durable

# Thresholds of the relative deviation by user group.
HEAVY_GROUPS = ("HEUG", "HDUG")
FLAG_GROUPS = ("HEUG", "HDUG", "MEUG", "MDUG")
WIDE = 0.075
NARROW = 0.05
# Activity quantiles of the second grouping.
TIER_QUANTILES = [0.5, 0.75]


@dataclass(frozen=True)
class CoherenceNoise:
    """``form='mean'`` flags the mean relative deviation, ``'fraction'`` the share of deviating genres."""

    form: str = "mean"
    grouping: str = "quantile"


def by_genre(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """One row per rating and genre of its item; pairs without a rating stay without one."""
    genres = items.select("itemId", genre_array(F.col("genres")).alias("genre_list"))
    held = ["userId", "itemId", *(c for c in ratings.columns if c == "rating")]
    return ratings.join(genres, "itemId").select(*held, F.explode("genre_list").alias("genre"))


def genre_means(ratings: DataFrame, items: DataFrame) -> DataFrame:
    return by_genre(ratings, items).groupBy("userId", "genre").agg(F.avg("rating").alias("avg_rating"))


def genre_profile(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: n_ratings, total (summed root of squared deviations from the genre means) and the means as a map.

    One join and two aggregates serve the coherence, the groups and the deviations. The map has an entry per
    genre of the catalogue at most. Every rating counts once, at its first genre or without one.
    """
    genres = items.select("itemId", genre_array(F.col("genres")).alias("genre_list"))
    rows = ratings.join(genres, "itemId", "left").select(
        "userId", "rating", F.posexplode_outer("genre_list").alias("pos", "genre")
    )
    per_genre = rows.groupBy("userId", "genre").agg(
        F.avg("rating").alias("avg_rating"),
        F.sqrt(F.var_pop("rating") * F.count("rating")).alias("spread"),
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n"),
    )
    listed = F.col("genre").isNotNull()
    return per_genre.groupBy("userId").agg(
        F.sum("n").alias("n_ratings"),
        F.coalesce(F.sum(F.when(listed, F.col("spread"))), F.lit(0.0)).alias("total"),
        F.map_from_entries(F.collect_list(F.when(listed, F.struct("genre", "avg_rating")))).alias("means"),
    )


def coherence_of(profile: DataFrame, normalised: bool = False) -> DataFrame:
    """Negated total in the first form; total over the root of the user's item count in the normalised form."""
    value = F.col("total") / F.sqrt("n_ratings") if normalised else -F.col("total")
    return profile.select("userId", "n_ratings", r6(value).alias("coherence"))


def coherence(ratings: DataFrame, items: DataFrame, normalised: bool = False) -> DataFrame:
    return coherence_of(genre_profile(ratings, items), normalised)


def groups_by_thirds(profile: DataFrame) -> DataFrame:
    """Activity by thirds of the busiest user's count; coherent when at least half the lowest coherence."""
    scored = coherence_of(profile)
    edge = scored.agg(F.struct(F.max("n_ratings").alias("most"), F.min("coherence").alias("lowest"))).scalar()
    n = F.col("n_ratings")
    tier = F.when(n * 3 >= edge["most"] * 2, "H").when(n * 3 >= edge["most"], "M").otherwise("L")
    kind = F.when(F.col("coherence") >= edge["lowest"] / 2, "EUG").otherwise("DUG")
    return scored.withColumn("user_group", F.concat(tier, kind))


def with_tiers(counts: DataFrame) -> DataFrame:
    """Append heavy / medium / light by the upper two quartiles of n_ratings."""
    cut = quantiles(counts, "n_ratings", TIER_QUANTILES).scalar()
    n = F.col("n_ratings")
    return counts.withColumn("tier", F.when(n >= cut[1], "heavy").when(n >= cut[0], "medium").otherwise("light"))


def tier_medians(tiered: DataFrame) -> DataFrame:
    return group_medians(tiered, ["tier"], "coherence", "median_coherence")


def groups_by_quantile(profile: DataFrame) -> DataFrame:
    """Tiers by quantile; coherent when at least the median of the own tier."""
    tiered = durable(with_tiers(coherence_of(profile, normalised=True)), "tiers")
    # At most three medians: a bounded side for the join.
    joined = tiered.join(F.broadcast(tier_medians(tiered)), "tier", "left")
    kind = F.when(F.col("coherence") >= F.coalesce(r6(F.col("median_coherence")), F.lit(0.0)), "EUG").otherwise("DUG")
    group = F.concat(F.upper(F.substring("tier", 1, 1)), kind)
    return joined.select("userId", "n_ratings", "coherence", group.alias("user_group"))


def stored_profile(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """The profile, one row per user, written once because grouping and scoring both read it."""
    return durable(genre_profile(ratings, items), "profile")


def user_groups(ratings: DataFrame, items: DataFrame, grouping: str = "quantile") -> DataFrame:
    profile = stored_profile(ratings, items)
    return groups_by_thirds(profile) if grouping == "thirds" else groups_by_quantile(profile)


def _with_deviations(ratings: DataFrame, items: DataFrame, groups: DataFrame, profile: DataFrame | None) -> DataFrame:
    """Attach user group and an array of relative deviations, one per genre.

    A user's means travel as one map, so ratings are joined on the user alone and need no regrouping.
    """
    means = (genre_profile(ratings, items) if profile is None else profile).select("userId", "means")
    genres = items.select("itemId", genre_array(F.col("genres")).alias("genre_list"))
    wanted = groups.select("userId", "user_group").join(means, "userId", "left")

    def deviation(g: Column) -> Column:
        mean = F.try_element_at(F.col("means"), g)
        return F.abs(F.col("rating") - mean) / mean

    return (
        ratings.join(genres, "itemId", "left")
        .join(wanted, "userId", "left")
        .withColumn("deviations", F.transform("genre_list", deviation))
        .drop("means")
    )


def _group_threshold(groups: tuple[str, ...]) -> Column:
    return F.when(F.col("user_group").isin(*groups), WIDE).otherwise(NARROW)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def rnd_fraction(ratings: DataFrame, items: DataFrame, groups: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Append rnd, the share of the item's genres whose deviation exceeds the group's threshold, and nf2."""
    th = _group_threshold(HEAVY_GROUPS)
    over = F.transform("deviations", lambda d: F.when(F.round(d, 9) > th, 1.0).otherwise(0.0))
    scored = _with_deviations(ratings, items, groups, profile).withColumn("rnd", _mean(over))
    return scored.withColumn("nf2", flag(F.col("rnd") > 0)).drop("deviations", "genre_list")


def rnd_mean(ratings: DataFrame, items: DataFrame, groups: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Append rnd (mean deviation, zeroed unless above the formula's threshold), thresh and nf2 = rnd > thresh."""
    mean = F.round(_mean(F.col("deviations")), 9)
    scored = _with_deviations(ratings, items, groups, profile).withColumn("rnd", mean)
    return (
        scored.withColumn("rnd", F.when(F.col("rnd") > _group_threshold(HEAVY_GROUPS), F.col("rnd")).otherwise(0.0))
        .withColumn("thresh", _group_threshold(FLAG_GROUPS))
        .withColumn("nf2", flag(F.col("rnd") > F.col("thresh")))
        .drop("deviations", "genre_list")
    )


def flag_coherence_noise(ratings: DataFrame, items: DataFrame, params: CoherenceNoise = CoherenceNoise()) -> DataFrame:
    profile = stored_profile(ratings, items)
    groups = groups_by_thirds(profile) if params.grouping == "thirds" else groups_by_quantile(profile)
    return (rnd_fraction if params.form == "fraction" else rnd_mean)(ratings, items, groups, profile)
