"""Tables of many rows in small files must not be collected for a broadcast; partitions that k-means keeps."""

from pyspark.sql import functions as F

from ratesift.operators import clustering as clu
from ratesift.operators import metrics as met
from ratesift.session import durable


def test_recommendations_are_not_collected_for_hits(spark, frame):
    recs = durable(frame([(u, i, 1) for u in range(50) for i in range(10)]).select("userId", "itemId", F.lit(1).alias("rank")))
    truth = durable(frame([(u, i, 1) for u in range(50) for i in range(0, 30, 4)]))
    hits = met.user_hits(recs, truth)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2, plan
    assert {(r.hit, r.actual) for r in hits.collect()} == {(3, 8)}


def test_labels_of_a_round_are_not_collected(spark, monkeypatch):
    hinted = []
    monkeypatch.setattr(clu, "by_shuffle", lambda df: hinted.append(df.hint("merge")) or hinted[-1])
    links = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (7, 8, 1)], "a long, b long, weight int")
    assert {(r.id, r.label) for r in clu.label_propagation(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert hinted


def test_rows_are_spread_before_clustering(spark, frame, monkeypatch):
    monkeypatch.setattr(clu, "PART_ROWS", 20)
    kept = []
    fit = clu.KMeans.fit
    monkeypatch.setattr(clu.KMeans, "fit", lambda self, df: kept.append(df.rdd.getNumPartitions()) or fit(self, df))
    ratings = frame([(u, i, (u + i) % 5 + 1) for u in range(10) for i in range(10)])
    items = spark.createDataFrame([(i, "x|y" if i % 2 else "y") for i in range(10)], "itemId long, genres string")
    rows = clu.rating_row_clusters(ratings, items, ["x", "y"], 3)
    assert rows.count() == 100 and kept == [5]
