"""Row-level and join operators on rating tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratesift.functions.scalars import genre_array

# Spellings of "not noisy" in stacked output.
CLEAN_SPELLINGS = ("[0.]", "0", "0.0")


def project_ratings(df: DataFrame, with_time: bool = False) -> DataFrame:
    return df.select("userId", "itemId", "rating", *(["ts"] if with_time else []))


def clean_rule(rule: str) -> Column:
    """The predicate that keeps clean ratings, by the kind of table they come from."""
    rules = {
        "stacked": F.col("isNoisy").cast("string").isin(*CLEAN_SPELLINGS),
        "all_ones": F.col("all_ones") == 0,
        "both": (F.col("all_ones") == 0) & (F.col("all_zeros") == 0),
        "framework": F.col("layer3_result") == 0,
        "flag": F.col("isNoisy") == 0,
    }
    return rules[rule]


def clean_view(df: DataFrame, rule: str = "flag") -> DataFrame:
    return df.where(clean_rule(rule))


def to_number(column: str) -> Column:
    return F.col(column).try_cast("double")


def strip_brackets(column: str) -> Column:
    return F.regexp_replace(column, r"[\[\]]", "")


def fix_merge_suffixes(df: DataFrame) -> DataFrame:
    """Keep the left side of a suffixed merge: ``a_x`` becomes ``a``, ``a_y`` goes."""
    kept = [c for c in df.columns if not c.endswith("_y")]
    return df.select(*[F.col(c).alias(c.removesuffix("_x")) for c in kept])


def drop_optional(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def zero_fill(df: DataFrame, *names: str) -> DataFrame:
    return df.fillna(0, list(names) or None)


def epoch_date(column: str = "ts") -> Column:
    """UTC date of epoch seconds, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(F.col(column) / 86400).cast("int"))


def genre_count(column: str = "genres") -> Column:
    return F.size(F.split(column, r"\|"))


def keep_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column), column, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column), column, "left_anti")


def with_items(ratings: DataFrame, items: DataFrame, how: str = "inner") -> DataFrame:
    """Broadcast or shuffle is left to the optimizer, which knows the catalogue's size."""
    return ratings.join(items, "itemId", how)


def recover_timestamp(flagged: DataFrame, ratings: DataFrame, how: str = "inner") -> DataFrame:
    """Bring back ts by user, item and rating; the rating is matched in whole half steps."""
    half = F.bround(F.col("rating") * 2).cast("int")
    source = ratings.select("userId", "itemId", half.alias("_half"), "ts")
    return flagged.withColumn("_half", half).join(source, ["userId", "itemId", "_half"], how).drop("_half")


def anti_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows equal to no right row on the shared columns; duplicates stay, missing equals missing."""
    shared = [c for c in left.columns if c in right.columns]
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in shared])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shared])
    return left.join(renamed, same, "left_anti")


def semi_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in shared])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shared])
    return left.join(renamed, same, "left_semi")


def attach_flag(ratings: DataFrame, noisy: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """1 for ratings whose keys occur among the noisy ones, 0 for the rest."""
    keys = keys or ["userId", "itemId"]
    marked = noisy.select(*keys).distinct().withColumn(name, F.lit(1))
    return ratings.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def restrict_edges(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Edges with both ends among the users."""
    left = users.select(F.col("userId").alias("truster"))
    right = users.select(F.col("userId").alias("trusted"))
    return edges.join(left, "truster", "left_semi").join(right, "trusted", "left_semi")


def distinct_genres(items: DataFrame) -> DataFrame:
    return items.select(F.explode(genre_array(F.col("genres"))).alias("genre")).distinct()


def support_filter(ratings: DataFrame, min_item: int = 150, min_user: int = 100) -> DataFrame:
    """Items rated more than min_item times, then users with more than min_user of the ratings left; one pass."""
    popular = ratings.groupBy("itemId").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_item)
    kept = keep_ids(ratings, popular, "itemId")
    active = kept.groupBy("userId").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_user)
    return keep_ids(kept, active, "userId")


def adjacency(edges: DataFrame) -> DataFrame:
    """Link counts over the union of ids, as rows; ids without links in a role keep a row with count 0 on the diagonal."""
    counts = edges.groupBy("truster", "trusted").agg(F.count(F.lit(1)).alias("n"))
    ids = edges.select(F.col("truster").alias("id")).union(edges.select("trusted")).distinct()
    diagonal = ids.select(F.col("id").alias("truster"), F.col("id").alias("trusted"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(diagonal).groupBy("truster", "trusted").agg(F.sum("n").alias("n"))
