"""Users who opt out of noise handling because much of what they rate looks noisy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ratesift.functions.scalars import flag


@dataclass(frozen=True)
class OptOut:
    share: float = 0.5
    at_least: int = 3


def noisy_ratings(flagged: DataFrame, column: str = "isNoisy") -> DataFrame:
    return flagged.where(F.col(column) == 1)


def opt_out_users(flagged: DataFrame, column: str = "isNoisy", params: OptOut = OptOut()) -> DataFrame:
    """(userId, OptOut) for users with noisy ratings: 1 when their noisy share and count are high."""
    noisy = F.count_if(F.col(column) == 1)
    counts = flagged.groupBy("userId").agg(noisy.alias("noisy"), F.count(F.lit(1)).alias("total"))
    high = (F.col("noisy") >= params.share * F.col("total")) & (F.col("noisy") >= params.at_least)
    return counts.where("noisy > 0").select("userId", flag(high).alias("OptOut"))


def attach_opt_out(ratings: DataFrame, opt_out: DataFrame) -> DataFrame:
    return ratings.join(opt_out, "userId", "left").withColumn("OptOut", F.coalesce("OptOut", F.lit(0)))


def layer3_result(ratings: DataFrame, column: str = "isNoisy") -> DataFrame:
    """Noisy and not opted out."""
    return ratings.withColumn("layer3_result", flag((F.col(column) == 1) & (F.col("OptOut") == 0)))
