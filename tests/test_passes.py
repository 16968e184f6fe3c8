"""Disk of long chains: written steps leave no shuffle files, and passes over the units give what one pass gives."""

import random

import pytest
from pyspark.sql import functions as F

from ratesift.operators import blocks
from ratesift.operators import neighbour_noise as nei
from ratesift.session import CLEANUP, durable


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().endswith(".data") for i in range(files.size()))


def test_a_written_step_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids"))
    stored = durable(rows.join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"), "step")
    assert stored.count() == 7 and shuffle_files(spark) <= before + 1 and spark.conf.get(CLEANUP) == setting


@pytest.mark.parametrize("copies", [False, True])
def test_passes_equal_one_pass(spark, frame, monkeypatch, copies):
    rng = random.Random(9)
    cells = sorted({(rng.randrange(70), rng.randrange(40)) for _ in range(900)})
    train = frame([(u, i, rng.randrange(1, 11) / 2) for u, i in cells if (u + i) % 4])
    test = frame([(u, i, 3.0) for u, i in cells if not (u + i) % 4])

    def results():
        return (
            sorted(nei.knn_with_means(train, test, nei.NeighbourNoise(k=5, block=8)).select("userId", "itemId", "est").collect()),
            sorted(nei.co_rating_summary(train, block=8).collect()), sorted(nei.top_neighbours(train, 4, block=8).collect()),
        )

    if copies:
        monkeypatch.setattr(blocks, "ASKED_PAIRS", 50)
    one = results()
    written = []
    monkeypatch.setattr(blocks, "PASS_PAIRS", 3000)
    monkeypatch.setattr(blocks, "durable", lambda df, name: written.append(name) or durable(df, name))
    assert results() == one and written.count("units") > 4
