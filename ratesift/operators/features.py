"""Feature tables for the ensembles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ratesift.functions.scalars import bits_to_number, flag, genre_array
from ratesift.operators.relational import distinct_genres

# Column names of the ratings and their features.
BASE = ["userId", "itemId", "rating", "ts"]
FLAG_FEATURES = ["nf1", "nf2", "nf3", "nf4"]
VALIDATION_FEATURES = ["Delta_GV_Y", "Delta_SERENDIPITY_X"]


def genre_names(items: DataFrame) -> list[str]:
    """Sorted genres of the catalogue: a few dozen names, needed as column names."""
    return [r.genre for r in distinct_genres(items).orderBy("genre").collect()]


def genre_bits(genres: Column, names: list[str]) -> Column:
    held = genre_array(genres)
    return F.concat(*[F.when(F.array_contains(held, g), "1").otherwise("0") for g in names])


def genre_number(genres: Column, names: list[str]) -> Column:
    """The bit string as a number; catalogues of up to 63 genres fit."""
    return bits_to_number(genre_bits(genres, names))


def one_hot_columns(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.select("*", *[flag(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def one_hot_vector(column: str) -> Pipeline:
    index = StringIndexer(inputCol=column, outputCol=f"{column}_index", handleInvalid="keep")
    return Pipeline(stages=[index, OneHotEncoder(inputCols=[f"{column}_index"], outputCols=[f"{column}_vec"])])


def with_features(table: DataFrame, names: list[str], use_flags: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Append the assembled vector: keys, rating, time, one flag per genre, filter flags and extra columns."""
    held = genre_array(F.col("genres"))
    genre_columns = [flag(F.array_contains(held, g)).alias(f"genre_{i}") for i, g in enumerate(names)]
    columns = [*BASE, *[f"genre_{i}" for i in range(len(names))], *(FLAG_FEATURES if use_flags else []), *(extra or [])]
    wide = table.select("*", *genre_columns)
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    return assembler.transform(wide).drop(*[f"genre_{i}" for i in range(len(names))])


def target_encoded(column: str = "genres", label: str = "label", smoothing: float = 20.0) -> Pipeline:
    """A whole string as one categorical feature: indexed, then replaced by its smoothed label mean."""
    index = StringIndexer(inputCol=column, outputCol=f"{column}_index", handleInvalid="keep")
    encode = TargetEncoder(
        inputCols=[f"{column}_index"], outputCols=[f"{column}_target"], labelCol=label, targetType="binary",
        smoothing=smoothing, handleInvalid="keep",
    )
    return Pipeline(stages=[index, encode])
