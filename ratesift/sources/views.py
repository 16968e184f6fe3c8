"""Rating-shaped views over the star-schema tables.

ratings  order lines as user-item ratings on the 0.5-5 half-step scale, latest per (user, item)
items    parts with a pipe-delimited genre string
users    customers with age, gender, occupation
trust    links between successive customers of a nation, value 1 or -1
sequences  events with the item in their properties
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratesift.functions.scalars import NO_GENRES
from ratesift.session import durable

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_seconds(column: str):
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, CAST({column} AS TIMESTAMP_NTZ))")


def latest_rating(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per (userId, itemId): the greatest by ``order``. A max over structs combines before the shuffle."""
    held = [*order, *(c for c in ("rating", "ts") if c not in order)]  # each once: the rows are sorted and shuffled
    best = F.max(F.struct(*held)).alias("b")
    return df.groupBy("userId", "itemId").agg(best).select("userId", "itemId", "b.rating", "b.ts")


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def rating_log(self) -> DataFrame:
        """Every rating event, repeats included."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("userId"),
            F.col("l_partkey").alias("itemId"),
            (F.ceil(F.col("l_quantity") / 5) * F.lit(0.5).cast("double")).alias("rating"),
            epoch_seconds("o_orderdate").alias("ts"),
            "l_orderkey",
            "l_linenumber",
        )

    @cached_property
    def ratings(self) -> DataFrame:
        return latest_rating(self.rating_log, ["ts", "l_orderkey", "l_linenumber"])

    @cached_property
    def stored(self) -> DataFrame:
        """The ratings written once to the shared folder, for queries that read them several times."""
        return durable(self.ratings, "ratings")

    @cached_property
    def items(self) -> DataFrame:
        genres = F.when(F.col("p_size") == 50, F.lit(NO_GENRES)).otherwise(
            F.concat_ws("|", "p_type", F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))
        )
        return self.table("part").select(
            F.col("p_partkey").alias("itemId"), F.col("p_name").alias("title"), genres.alias("genres")
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("userId"),
            (18 + F.col("c_custkey") % 60).alias("age"),
            F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("gender"),
            F.col("c_mktsegment").alias("occupation"),
        )

    @cached_property
    def trust(self) -> DataFrame:
        """Links between successive orders of a nation.

        Nations are few, so a window per nation would put a 25th of all orders (or more) into one task. The
        window runs per (nation, day) instead; the first order of a day takes its predecessor from a small
        table of each day's last customer.
        """
        joined = (
            self.table("orders")
            .select("o_orderkey", "o_custkey", "o_orderdate")
            .join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("day", F.to_date("o_orderdate"))
        )
        order = F.struct("o_orderdate", "o_orderkey")
        last = joined.groupBy("c_nationkey", "day").agg(F.max_by("o_custkey", order).alias("last_user"))
        carried = last.select(
            "c_nationkey",
            "day",
            F.lag("last_user").over(Window.partitionBy("c_nationkey").orderBy("day")).alias("carry"),
        )
        inside = Window.partitionBy("c_nationkey", "day").orderBy("o_orderdate", "o_orderkey")
        linked = joined.withColumn("prev", F.lag("o_custkey").over(inside)).join(carried, ["c_nationkey", "day"])
        return (
            linked.select(
                F.col("o_custkey").alias("truster"),
                F.coalesce("prev", "carry").alias("trusted"),
                F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1).alias("value"),
                F.to_date("o_orderdate").alias("date"),
            )
            .where("trusted IS NOT NULL AND truster <> trusted")
        )

    @cached_property
    def sequences(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("userId"),
            F.get_json_object("props", "$.k").cast("long").alias("itemId"),
            F.col("event_type").alias("category"),
            epoch_seconds("ts").alias("ts"),
        )
