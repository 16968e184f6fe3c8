"""Noise by fuzzy profiles: a rating that fits neither its user's nor its item's low/medium/high profile."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ratesift.functions.scalars import flag, manhattan, sharpen, trapezoid

LABELS = ("low", "medium", "high")
# Inner corners of the memberships on the half-step and five-step rating scales,
# the eligibility distance, the noise distance and the size below which a profile counts as variable.
LOW_FULL_TO, LOW_ZERO_FROM = 1.5, 2.0
MEDIUM_CORNERS = (1.5, 2.0, 3.0, 4.0)
HIGH_ZERO_TO, HIGH_FULL_FROM = 3.0, 4.0
KNOWN_SCALE = (0.5, 5.0)
ELIGIBLE_DISTANCE = 1.0
NOISE_DISTANCE = 1.0
VARIABLE_BELOW = 0.01


@dataclass(frozen=True)
class FuzzyNoise:
    """``full=True`` measures eligibility on all three labels instead of the low one.

    Without ``r_min`` and ``r_max`` the scale is that of the ratings (``fitted``).
    """

    r_min: float | None = None
    r_max: float | None = None
    full: bool = False
    corners: tuple[tuple[float, float, float, float], ...] | None = None


def boundaries(r_min: float, r_max: float, rating_scale: bool = True) -> tuple[tuple[float, ...], ...]:
    """Corners of low, medium and high.

    Scales other than the two known ones place the corners by quarter and tenth of the range around the middle.
    """
    if rating_scale:
        return (
            (r_min, r_min, LOW_FULL_TO, LOW_ZERO_FROM),
            MEDIUM_CORNERS,
            (HIGH_ZERO_TO, HIGH_FULL_FROM, r_max, r_max),
        )
    span, middle = r_max - r_min, (r_max + r_min) / 2
    low, high = r_min + span / 4, r_max - span / 4
    left, right = middle - span / 10, middle + span / 10
    return ((r_min, r_min, low, left), (low, left, right, high), (right, high, r_max, r_max))


def fitted(ratings: DataFrame, params: FuzzyNoise = FuzzyNoise()) -> FuzzyNoise:
    """Parameters with the scale's ends, from the ratings where they are not given: one row of two numbers."""
    if params.corners or None not in (params.r_min, params.r_max):
        return params
    low, high = ratings.agg(F.min("rating"), F.max("rating")).first()
    ends = [float(given if given is not None else found if found is not None else known)
            for given, found, known in ((params.r_min, low, KNOWN_SCALE[0]), (params.r_max, high, KNOWN_SCALE[1]))]
    return replace(params, r_min=ends[0], r_max=ends[1])


def _corners(params: FuzzyNoise):
    """The fixed corners for scales that end at the known one's top, the relative ones for all others."""
    return params.corners or boundaries(params.r_min, params.r_max, params.r_max == KNOWN_SCALE[1])


def rating_profile(params: FuzzyNoise) -> list[Column]:
    """Sharpened memberships of ``rating`` as columns r_low, r_medium, r_high; ``params`` are fitted."""
    return [
        sharpen(trapezoid(F.col("rating"), *c)).alias(f"r_{label}")
        for label, c in zip(LABELS, _corners(params), strict=True)
    ]


def profile_by(ratings: DataFrame, key: str, prefix: str, params: FuzzyNoise = FuzzyNoise()) -> DataFrame:
    """Mean memberships per key, sharpened again."""
    params = fitted(ratings, params)
    profiled = ratings.select(key, *rating_profile(params))
    means = profiled.groupBy(key).agg(*[F.avg(f"r_{x}").alias(x) for x in LABELS])
    return means.select(key, *[F.round(sharpen(F.round(x, 9)), 9).alias(f"{prefix}_{x}") for x in LABELS])


def with_profiles(ratings: DataFrame, params: FuzzyNoise = FuzzyNoise()) -> DataFrame:
    params = fitted(ratings, params)
    return (
        ratings.select("*", *rating_profile(params))
        .join(profile_by(ratings, "userId", "u", params), "userId")
        .join(profile_by(ratings, "itemId", "i", params), "itemId")
    )


def _triple(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{x}") for x in LABELS]


def eligible(params: FuzzyNoise = FuzzyNoise()) -> Column:
    """Both profiles are close and neither is variable (all memberships near zero)."""
    distance = manhattan(_triple("u"), _triple("i")) if params.full else F.abs(F.col("u_low") - F.col("i_low"))

    def variable(prefix: str) -> Column:
        return F.greatest(*_triple(prefix)) < VARIABLE_BELOW

    return (F.round(distance, 9) < ELIGIBLE_DISTANCE) & ~variable("u") & ~variable("i")


def noise_degree() -> Column:
    """The smaller of the rating's distances to its user's and its item's profile."""
    return F.round(
        F.least(manhattan(_triple("u"), _triple("r")), manhattan(_triple("i"), _triple("r"))), 9
    )


def flag_fuzzy_noise(ratings: DataFrame, params: FuzzyNoise = FuzzyNoise()) -> DataFrame:
    """Append eligible, degree and nf4."""
    drop = [f"{p}_{x}" for p in "rui" for x in LABELS]
    return (
        with_profiles(ratings, params)
        .withColumn("eligible", flag(eligible(params)))
        .withColumn("degree", noise_degree())
        .withColumn("nf4", flag((F.col("eligible") == 1) & (F.col("degree") >= NOISE_DISTANCE)))
        .drop(*drop)
    )
