"""Reuse of written tables by what they were computed from."""

import os

from pyspark.sql import functions as F

from ratesift.sources.sinks import input_key, materialize_once


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tables_are_reused_by_plan_and_input(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)

    def small(limit=3):
        return spark.read.parquet(source).where(F.col("id") < limit)

    first = materialize_once(small(), target)
    again = materialize_once(small(), target)
    assert ids(first) == ids(again) == [0, 1, 2] and first.inputFiles() == again.inputFiles()
    assert ids(materialize_once(small(4), target)) == [0, 1, 2, 3]  # another plan
    assert materialize_once(small(), target, "2").inputFiles() != first.inputFiles()  # another version
    spark.range(2, 9).write.mode("append").parquet(source)  # other input
    assert ids(materialize_once(small(), target)) == [0, 1, 2, 2] and ids(first) == [0, 1, 2]


def test_half_written_and_unkeyed_tables_are_written_anew(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    whole = materialize_once(spark.read.parquet(source), target)
    folder = os.path.dirname(whole.inputFiles()[0].removeprefix("file://"))
    os.rename(f"{folder}/_SUCCESS", f"{folder}/_OTHER")
    assert materialize_once(spark.read.parquet(source), target).inputFiles() != whole.inputFiles()
    local = spark.createDataFrame([(1,)], "id long")
    assert input_key(local) is None and ids(materialize_once(local, target)) == [1]
    other = spark.createDataFrame([(2,)], "id long")
    assert ids(materialize_once(other, target)) == [2]


def test_wide_plans_differ_in_late_columns(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    wide = [spark.read.parquet(source).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)], (F.col("id") + x).alias("last")) for x in (1, 2, 1)]
    keys = [input_key(w) for w in wide]
    assert keys[0] == keys[2] != keys[1]
