"""Writers. Every sink is a parallel Spark write; completion is the success marker, not the folder's existence."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def _at(spark: SparkSession, path: str):
    """(file system, path) on any file system Spark can reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its marker."""
    files, place = _at(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def input_key(df: DataFrame, version: str = "") -> str | None:
    """A digest of what ``df`` computes and of the files it reads (names, sizes, times), the same in every session.

    None where the rows don't come from files alone: their content can't be told from the plan. Python functions count
    by name only; a change of their code needs another ``version``.
    """
    spark, width = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(width)
    spark.conf.set(width, str(2**31 - 1))
    try:
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        spark.conf.set(width, before)
    read = set(df.inputFiles())
    if not read or re.search(r"\b(LocalRelation|LogicalRDD|ExternalRDD)\b", plan):
        return None
    found = []
    for folder in sorted({name.rsplit("/", 1)[0] for name in read}):
        files, place = _at(spark, folder)
        for status in files.listStatus(place):
            name = status.getPath().toUri().toString()
            found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    parts = [version, re.sub(r"#\d+L?", "", plan), df.schema.json(), *sorted(read), *sorted(found)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def materialize_once(df: DataFrame, path: str, version: str = "") -> DataFrame:
    """Reuse the table below ``path`` that was written from the same plan and input files; otherwise write it.

    Every write has a folder of its own, so two writers never mix, and half-written ones are passed over. Tables of
    other input stay for their readers.
    """
    spark, key = df.sparkSession, input_key(df, version)
    own = f"{path}/{key or 'unkeyed'}"
    files, place = _at(spark, own)
    written = sorted(s.getPath().toString() for s in files.listStatus(place)) if key and files.exists(place) else []
    done = next((w for w in written if is_complete(spark, w)), None)
    if done is None:
        done = f"{own}/{uuid.uuid4().hex}"
        df.write.parquet(done)
    return spark.read.schema(df.schema).parquet(done)


def write_likelihood(likelihood: DataFrame, path: str) -> None:
    """User genre likelihoods, one folder per genre."""
    write_table(likelihood.select("userId", "likelihood", "genre"), path, partition_by=["genre"])


def write_embeddings(vectors: DataFrame, path: str) -> None:
    write_table(vectors.select("id", "vec"), path)
