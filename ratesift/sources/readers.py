"""File readers with declared schemas, and column-name normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratesift.functions.scalars import genre_array

RATINGS_SCHEMA = "userId long, itemId long, rating double, timestamp long"
TRAIN_SCHEMA = "userId long, itemId long, rating double"
ITEMS_SCHEMA = "itemId long, title string, genres string"
LATIN1 = "ISO-8859-1"

# The spellings of the key columns found in rating files.
COLUMN_NAMES = {
    "userID": "userId", "user_id": "userId", "movieId": "itemId", "itemID": "itemId", "item_id": "itemId",
}
# The genre flag columns of the 100k item file, in file order.
FLAG_GENRES = (
    "unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy",
    "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
)


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in COLUMN_NAMES.items() if old in df.columns})


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings CSV with header: user, item, rating, epoch seconds."""
    return spark.read.schema(RATINGS_SCHEMA).csv(path, header=True, enforceSchema=True)


def read_training_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAIN_SCHEMA).csv(path, header=True, enforceSchema=True)


def read_items(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(ITEMS_SCHEMA).csv(path, header=True, encoding=encoding, enforceSchema=True)


def read_ml100k(spark: SparkSession, folder: str, genres: tuple[str, ...] = FLAG_GENRES):
    """The headerless files u.data, u.item, u.user and u.genre; genre flags become a string array."""
    data = spark.read.schema("userId long, itemId long, rating double, timestamp long").csv(
        f"{folder}/u.data", sep="\t"
    )
    flags = ", ".join(f"g{i} int" for i in range(len(genres)))
    raw = spark.read.schema(f"itemId long, title string, released string, video string, url string, {flags}").csv(
        f"{folder}/u.item", sep="|", encoding=LATIN1
    )
    named = F.array(*[F.when(F.col(f"g{i}") == 1, F.lit(g)) for i, g in enumerate(genres)])
    items = raw.select("itemId", "title", "released", F.array_compact(named).alias("genres"))
    users = spark.read.schema("userId long, age long, gender string, occupation string").csv(
        f"{folder}/u.user", sep="|", encoding=LATIN1
    )
    genre = spark.read.schema("genre string, position int").csv(f"{folder}/u.genre", sep="|")
    return data, items, users, genre


def read_epinions_ratings(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Tab-separated lines of uneven length; the first four fields are kept, lines without a rating dropped."""
    raw = spark.read.schema("itemID long, userID long, rating double, status long").csv(
        path, sep="\t", mode="PERMISSIVE"
    )
    raw = raw if max_rows is None else raw.limit(max_rows)
    return normalize_columns(raw.where("rating IS NOT NULL"))


def read_trust(spark: SparkSession, path: str, positive_only: bool = True) -> DataFrame:
    """Trust links; by default only those of value 1."""
    links = spark.read.schema("truster long, trusted long, value int, date date").csv(path, sep="\t")
    return links.where("value = 1") if positive_only else links


def read_genre_lists(items: DataFrame) -> DataFrame:
    return items.withColumn("genre_list", genre_array(F.col("genres")))


def read_likelihood(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("userId long, likelihood double, genre string").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, vec array<double>").parquet(path)
