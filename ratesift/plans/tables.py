"""Sources and sinks: the views written in each file format and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratesift.functions.scalars import genre_array, r6
from ratesift.operators import metrics, relational
from ratesift.operators.category_noise import flag_category_noise
from ratesift.plans.registry import query
from ratesift.session import durable, scratch_path
from ratesift.sources import readers, sinks


@query("a1_read_ratings", "ratings", 'SELECT userId, itemId, rating, ts AS "timestamp" FROM ratings')
def read_ratings(t):
    path = scratch_path(t.spark, "ratings")
    sinks.write_table(t.ratings.withColumnRenamed("ts", "timestamp"), path, "csv", header=True)
    return readers.read_ratings(t.spark, path)


@query("a2_read_training_ratings", "ratings", "SELECT userId, itemId, rating FROM ratings")
def read_training_ratings(t):
    path = scratch_path(t.spark, "train")
    sinks.write_table(t.ratings.select("userId", "itemId", "rating"), path, "csv", header=True)
    return readers.read_training_ratings(t.spark, path)


@query("a3_read_items", "items", "SELECT itemId, title, genres FROM items")
def read_items(t):
    path = scratch_path(t.spark, "items")
    sinks.write_table(t.items, path, "csv", header=True, encoding=readers.LATIN1)
    return readers.read_items(t.spark, path, readers.LATIN1)


@query("a4_read_ml100k", "ratings items users", """SELECT r.userId, itemId, rating, ts AS "timestamp", title, age, gender,
    occupation, CASE WHEN genres = '(no genres listed)' THEN '' ELSE
    array_to_string(list_sort(string_split(genres, '|')), '|') END AS genres
    FROM ratings r JOIN items USING (itemId) JOIN users USING (userId)""")
def read_ml100k(t):
    """Ratings, items with flag columns, users and the genre list as headerless files, read and joined."""
    folder = scratch_path(t.spark, "ml100k")
    sinks.write_table(t.ratings.select("userId", "itemId", "rating", "ts"), f"{folder}/u.data", "csv", sep="\t")
    # The catalogue's genres become columns: a few dozen names.
    names = tuple(r.genre for r in relational.distinct_genres(t.items).orderBy("genre").collect())
    held = genre_array(F.col("genres"))
    flags = [F.array_contains(held, g).cast("int").alias(f"g{i}") for i, g in enumerate(names)]
    unused = [F.lit("").alias(c) for c in ("released", "video", "url")]
    sinks.write_table(
        t.items.select("itemId", "title", *unused, *flags), f"{folder}/u.item", "csv", sep="|", encoding=readers.LATIN1
    )
    sinks.write_table(t.users, f"{folder}/u.user", "csv", sep="|", encoding=readers.LATIN1)
    positions = t.spark.createDataFrame([(g, i) for i, g in enumerate(names)], "genre string, position int")
    sinks.write_table(positions, f"{folder}/u.genre", "csv", sep="|")
    data, items, users, _ = readers.read_ml100k(t.spark, folder, names)
    joined = F.array_join(F.array_sort("genres"), "|").alias("genres")
    return data.join(items.select("itemId", "title", joined), "itemId").join(users, "userId")


@query("a5_read_epinions_ratings", "ratings", "SELECT userId, itemId, rating, itemId % 3 AS status FROM ratings")
def read_epinions_ratings(t):
    """Tab-separated lines with a tail of varying length."""
    path = scratch_path(t.spark, "epinions")
    tail = F.when(F.col("userId") % 2 == 0, F.lit("\tx\ty")).otherwise(F.lit(""))
    lines = F.concat_ws("\t", "itemId", "userId", "rating", F.col("itemId") % 3)
    sinks.write_table(t.ratings.select(F.concat(lines, tail).alias("value")), path, "text")
    return readers.read_epinions_ratings(t.spark, path)


@query("a6_read_trust", "trust", "SELECT truster, trusted, value, date FROM trust WHERE value = 1")
def read_trust(t):
    path = scratch_path(t.spark, "trust")
    sinks.write_table(t.trust, path, "csv", sep="\t")
    return readers.read_trust(t.spark, path)


@query("a7_normalize_columns", "", "SELECT user_id AS userId, event_id AS itemId, value AS rating FROM events")
def normalize_columns(t):
    spelled = t.table("events").select("user_id", F.col("event_id").alias("movieId"), F.col("value").alias("rating"))
    return readers.normalize_columns(spelled)


@query("a8_write_table", "f1", "SELECT userId, itemId, rating, nf1 FROM f1")
def write_table(t):
    path = scratch_path(t.spark, "nf1")
    flagged = flag_category_noise(t.ratings).select("userId", "itemId", "rating", "nf1")
    sinks.write_table(flagged, path, partition_by=["nf1"])
    return t.spark.read.schema("userId long, itemId long, rating double, nf1 int").parquet(path)


@query("a9_materialize_once", "ratings", "SELECT itemId, count(*) AS n FROM ratings GROUP BY itemId")
def materialize_once(t):
    """The second call reads what the first one wrote."""
    path = scratch_path(t.spark, "counts")
    counts = t.ratings.groupBy("itemId").agg(F.count(F.lit(1)).alias("n"))
    sinks.materialize_once(counts, path)
    return sinks.materialize_once(counts, path)


@query("a10_likelihood_table", "rg", """SELECT userId, genre, round(count(*) / sum(count(*)) OVER (PARTITION BY userId), 6)
    AS likelihood FROM rg GROUP BY userId, genre""")
def likelihood_table(t):
    """The rated pairs are written first, so that no task both makes them distinct and counts their genres."""
    path = scratch_path(t.spark, "likelihood")
    rated = durable(t.ratings.select("userId", "itemId"), "rated")
    sinks.write_likelihood(metrics.genre_likelihood(rated, t.items), path)
    return readers.read_likelihood(t.spark, path).select("userId", "genre", r6(F.col("likelihood")).alias("likelihood"))


@query("a11_embedding_table", "", """SELECT vec_id AS id, len(embedding) AS dims,
    round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def embedding_table(t):
    """The vectors as arrays of doubles, written and read back."""
    path = scratch_path(t.spark, "embeddings")
    vectors = t.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    sinks.write_embeddings(vectors, path)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return readers.read_embeddings(t.spark, path).select("id", F.size("vec").cast("long").alias("dims"), r6(total).alias("total"))
