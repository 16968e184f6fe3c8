"""Counts per noise filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratesift.functions.scalars import r6


def noise_report(flagged: DataFrame, filters: list[str]) -> DataFrame:
    """Users, items, rows, noisy rows and their share, one row per filter, in one pass over the ratings."""
    totals = flagged.agg(
        F.count_distinct("userId").alias("users"),
        F.count_distinct("itemId").alias("items"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(F.col(f).cast("long")).alias(f) for f in filters],
    )
    lines = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f).alias("noisy")) for f in filters]))
    return totals.select("users", "items", "n_rows", lines.alias("x")).select(
        "x.filter", "users", "items", "n_rows", "x.noisy", r6(F.col("x.noisy") / F.col("n_rows")).alias("noisy_share")
    )
