"""Scalar column expressions. All stay inside generated code; none calls Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the rating-noise definitions.
NO_GENRES = "(no genres listed)"
SHARPEN_K = 0.35
ESTIMATE_PATTERN = r"est = ([0-9]+\.[0-9]+)"
ESTIMATE_CHARS = 4


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits).cast("double")


def r6(x: Column) -> Column:
    """Doubles leave a query at six digits, so that summation order cannot change the result."""
    return F.round(x.cast("double"), 6)


def ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """Division that answers ``otherwise`` for a zero or missing divisor."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(otherwise))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def genre_array(genres: Column) -> Column:
    """``A|B`` to trimmed array; the sentinel, empty and missing strings give an empty array."""
    parts = F.transform(F.split(F.coalesce(genres, F.lit("")), r"\|"), lambda g: F.trim(g))
    return F.filter(parts, lambda g: (g != F.lit(NO_GENRES)) & (g != F.lit("")))


def has_genre(genres: Column, genre: str, substring: bool = False) -> Column:
    return genres.contains(genre) if substring else F.array_contains(genre_array(genres), genre)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership rising over a-b, full over b-c, falling over c-d; a = b or c = d makes a shoulder."""
    expr = F.when((x < a) | (x > d), 0.0)
    if b > a:
        expr = expr.when(x < b, (x - a) / (b - a))
    expr = expr.when(x <= c, 1.0)
    return expr.otherwise((d - x) / (d - c)) if d > c else expr.otherwise(0.0)


def sharpen(x: Column, k: float = SHARPEN_K) -> Column:
    return F.when(x > k, (x - k) / (1 - k)).otherwise(x)


def manhattan(left: list[Column], right: list[Column]) -> Column:
    total = F.lit(0.0)
    for a, b in zip(left, right, strict=True):
        total = total + F.abs(a - b)
    return total


def estimate_from_text(text: Column) -> Column:
    """The estimate inside a stored prediction text, cut to its first four characters."""
    return F.substring(F.regexp_extract(text, ESTIMATE_PATTERN, 1), 1, ESTIMATE_CHARS).try_cast("double")


def bits_to_number(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")


def pearson_distance(x: Column, y: Column) -> Column:
    """Aggregate: one minus the correlation of two columns; missing when either does not vary."""
    return 1 - F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def grid(start: float, stop: float, points: int) -> Column:
    """Array of ``points`` evenly spaced numbers, both ends included."""
    step = (stop - start) / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(start) + i * F.lit(step))


def split_key(user: Column, item: Column, seed: int = 42, extra: Column | int = 0) -> Column:
    """Portable pseudo-random key of a rating in [0, 1000003)."""
    return (user * 7919 + item * 104729 + extra + seed) % 1000003
