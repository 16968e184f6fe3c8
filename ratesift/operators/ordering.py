"""Exact ranks and quantiles that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratesift.session import durable

KEY_SPACE = 1000003  # range of the portable split key
KEY_BUCKETS = 1000
SAMPLE_RANGE = 16  # keys of a range that is counted as one when a sample's last row is sought
MEDIAN_ROWS, MEDIAN_PARTS = 100_000, 256  # rows of a range that may be sorted, parts of a wider one


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Append the 1-based position under ``order``.

    The sort is range-partitioned; positions inside a partition come from the row id, and the offsets of the
    partitions from one row per partition. The sorted rows are written once, so that ids and offsets agree.
    """
    row_id = F.monotonically_increasing_id()
    placed = durable(
        df.orderBy(*order).withColumn("_pos", row_id).withColumn("_part", F.shiftright("_pos", 33)), "sorted"
    ).withColumn("_pos", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_off") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_off")
    )


def group_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", size: str = "size") -> DataFrame:
    """1-based rank inside each group and the group's size, through one global order."""
    ranked = global_rank(df, [F.col(k) for k in keys] + order, "_grank")
    starts = ranked.groupBy(*keys).agg(F.min("_grank").alias("_start"), F.count(F.lit(1)).alias(size))
    return ranked.join(starts, keys).withColumn(name, F.col("_grank") - F.col("_start") + 1).drop("_grank", "_start")


def hashed_rank(df: DataFrame, keys: list[str], key: Column, tie: list[str], name: str = "rank", size: str = "size",
                buckets: int = KEY_BUCKETS) -> DataFrame:
    """Rank by a uniform key in [0, KEY_SPACE) inside each group, with the group's size.

    Rows are windowed per (group, key bucket); bucket counts, at most ``buckets`` + 1 per group and combined
    before their shuffle, give the offsets. A hot group is spread over its buckets.
    """
    bucketed = df.withColumn("_key", key).withColumn("_b", F.floor(F.col("_key") * buckets / KEY_SPACE))
    counts = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(group).alias(size),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_key", *tie)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_key", "_b", "_rn", "_off")
    )


def smallest_n(df: DataFrame, key: Column, tie: list[str], n: Column | int) -> DataFrame:
    """The n rows with the smallest uniform key in [0, KEY_SPACE); n may be a scalar subquery.

    Rows are counted per range of SAMPLE_RANGE keys, combined before the shuffle. Rows of the ranges ahead of the one
    that holds the n-th row are taken as they are; only rows of that one range are ranked. No other row is moved.
    """
    ranged = df.withColumn("_key", key).withColumn("_b", F.floor(F.col("_key") / SAMPLE_RANGE))
    limit = F.lit(n) if isinstance(n, int) else n
    counts = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")  # a row per range at most
    cut = counts.withColumn("_before", before).where(F.col("_before") < limit).agg(F.max(F.struct("_b", "_before"))).scalar()
    whole = ranged.where(F.col("_b") < cut["_b"])
    part = top_per_group(ranged.where(F.col("_b") == cut["_b"]), ["_b"], [F.asc("_key"), *map(F.asc, tie)], limit - cut["_before"], "_rank")
    return whole.unionByName(part.drop("_rank")).drop("_key", "_b")


def quantiles(df: DataFrame, value: str, probs: list[float]) -> DataFrame:
    """Exact interpolated quantiles of a column with few distinct values, as one array ``q``.

    Equal values are counted before the aggregate, whose state is then one entry per distinct value.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.percentile(value, F.array(*[F.lit(p) for p in probs]), F.col("_n")).alias("q"))


def group_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group of a column of finite numbers, by selection; missing values don't count.

    Each group's middle places start with the range of all its values. A range of many rows is cut into equal parts,
    rows are counted per part before the shuffle, and the part that holds the place is the next range, told by the
    values in it. A range of one value is done; one of few rows is sorted. So no group is ever sorted whole, and rounds
    grow with the logarithm of its size.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    n, place, low, high = (F.col(c) for c in ("_in", "_place", "_lo", "_hi"))
    middles = F.array_distinct(F.array(F.floor((n + 1) / 2), F.floor((n + 2) / 2)))
    spans = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_in"))
    state = durable(spans.withColumn("_place", F.explode(middles)).withColumn("_before", F.lit(0).cast("long")), "middles")
    wide = (n > MEDIAN_ROWS) & (low < high)
    while not state.where(wide).isEmpty():
        inside = rows.join(state.where(wide), keys).where(F.col("_v").between(low, high))
        part = F.least(F.floor((F.col("_v") - low) / (high - low) * MEDIAN_PARTS), F.lit(MEDIAN_PARTS - 1))
        counted = inside.groupBy(*keys, "_place", "_before", part.alias("_part")).agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_in")
        )
        ahead = F.sum("_in").over(Window.partitionBy(*keys, "_place").orderBy("_part")) - n
        next_ = counted.withColumn("_before", F.col("_before") + ahead).where((place > F.col("_before")) & (place <= F.col("_before") + n))
        state = durable(state.where(~wide).unionByName(next_.drop("_part")), "middles")
    narrow = rows.join(state.where(low < high), keys).where(F.col("_v").between(low, high))
    order = F.row_number().over(Window.partitionBy(*keys, "_place").orderBy("_v"))
    found = narrow.withColumn("_rank", order + F.col("_before")).where(F.col("_rank") == place).select(*keys, "_v")
    single = state.where(low == high).select(*keys, low.alias("_v"))
    return found.unionByName(single).groupBy(*keys).agg(F.avg("_v").alias(name))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: Column | int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark limits each group inside the map tasks before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def dense_index(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct ids with a dense 0-based index in id order."""
    return global_rank(df.select(column).distinct(), [F.col(column)], "_r").select(
        column, (F.col("_r") - 1).alias(name)
    )
