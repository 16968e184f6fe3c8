"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without blanks at both ends and with A to Z lower-cased; keys are held as two 64-bit hashes.
Documents arrive in batches. A batch is merge-anti-joined with the runs so far: keys that are already found in enough
documents need no more counting. What is left is counted and written as a new run, sorted by key, on level 0. Once a
level holds ``fanout`` runs, they are merged into one run of the next level, so the number of runs stays logarithmic.
Counting over runs reads all of them in one scan and deals them by key once.

Lines whose key is found in enough documents are dropped from every document, wherever they stand.

Defined cases: a null or empty text is one empty line; blank lines have an empty key and always stay; every row counts
as a document, repeated rows too; a text that loses all its lines becomes empty; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratesift.llm.columns import BLANKS, ascii_lower, text_or_empty
from ratesift.session import durable, scratch_path

KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


class LineRuns:
    """Line counts in levelled sorted runs; ``enough``: counts from which a key needs no more counting."""

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 2):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        path = scratch_path(self.spark, "line_run")
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def _merged(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("k1 long, k2 long, n long").parquet(*runs).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame | None:
        """Documents per key over all runs."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else None

    def add(self, batch: DataFrame) -> None:
        """Count a batch of keys, one row for each key of each document."""
        counted = batch.groupBy(*KEY).agg(F.count("*").alias("n"))
        if (known := self.counts()) is not None:
            counted = counted.join(known.where(F.col("n") >= self.enough).select(*KEY), KEY, "left_anti")
        self._push(0, self._write(counted))

    def _push(self, level: int, run: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            run, self.levels[level] = self._write(self._merged(self.levels[level])), []
            self._push(level + 1, run)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a key: row identity, place, key hashes, and whether the key is new in its document."""
    keys = F.transform(F.split(text_or_empty(), "\n", -1), line_key)
    hashed = F.transform(keys, lambda k, i: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit("line"), k).alias("k2"), i.alias("pos"), (k != "").alias("full")))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), F.array_sort(hashed).alias("keys"))
    rows = rows.select("doc_id", "text_hash", F.posexplode("keys").alias("at", "key"), "keys")
    last = F.get("keys", F.col("at") - 1)
    first = (F.col("at") == 0) | (last["k1"] != F.col("key.k1")) | (last["k2"] != F.col("key.k2"))
    return rows.where("key.full").select("doc_id", "text_hash", "key.pos", "key.k1", "key.k2", first.alias("first"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped): every text without the lines found in ``min_docs`` documents or more.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    _lines(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches))).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, text_hash long, pos int, k1 long, k2 long, first boolean, batch int").parquet(path)
    runs = LineRuns(spark, min_docs)
    for i in range(batches):
        runs.add(lines.where((F.col("batch") == i) & F.col("first")).select(*KEY))
    common = durable(runs.counts().where(F.col("n") >= min_docs).select(*KEY), "common_lines")
    dropped = lines.join(common, KEY, "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"), carried.alias("carried"))
    cut = dropped.select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "dropped")
    rows = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left")
    rows = rows.select("doc_id", "text", "dropped", "carried", F.split("text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), *[F.col(f"carried.{c}").alias(c) for c in keep or []],
    )
