"""Metrics by hand, learned models on planted structure."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ratesift.operators import groupval as gv
from ratesift.operators import isolation as iso
from ratesift.operators import metrics as met
from ratesift.operators import relational as rel
from ratesift.operators import sampling as sam
from ratesift.operators import selftraining as slf
from ratesift.operators.learners import scaled, with_fourier
from ratesift.operators.stacking import Stacking


@pytest.fixture(scope="module")
def planted(spark):
    """Class 1 lies to the upper right; a fifth of the rows has no label."""
    rng = np.random.default_rng(0)
    rows = []
    for n in range(200):
        label = n % 2
        x = rng.normal(2.5 * label, 1, 3).tolist()
        rows.append((n, n % 40, n, label, x))
    df = spark.createDataFrame(rows, "id long, userId long, itemId long, label int, x array<double>")
    df = df.withColumn("features", array_to_vector("x")).drop("x")
    train, test = scaled(df.where("id >= 40"), df.where("id < 40"))
    return with_fourier(train, 3).cache(), with_fourier(test, 3).cache()


def test_stacking_learns_the_planted_classes(planted):
    train, test = planted
    model = Stacking(("knn", "tree", "radial_svm", "bayes"), folds=3).fit(train)
    predicted = model.predict(test)
    assert predicted.count() == 40
    assert predicted.where("prediction = label").count() >= 34


def test_self_training_and_vote(planted):
    train, test = planted
    keep = ["userId", "itemId", "label", "features"]
    (model, reached), = slf.ressel(train.select(keep), test.select(keep), ("logistic",), slf.SelfTraining(rounds=2))
    assert reached > 0.8
    predicted = slf.predict_ensemble([model, model], test.select(keep), "majority")
    assert predicted.where("prediction = label").count() >= 34
    votes = test.select(slf.vote([F.lit(1), F.lit(0), F.lit(0)]).alias("any"),
                        slf.vote([F.lit(1), F.lit(0), F.lit(0)], "majority").alias("most")).first()
    assert (votes["any"], votes["most"]) == (1, 0)


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(1)
    rows = [(n, rng.normal(0, 1, 3).tolist()) for n in range(300)] + [(1000 + n, [9.0 + n, -9.0, 9.0]) for n in range(3)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    forest = iso.fit_forest(df, iso.IsolationForest(trees=40, sample=64))
    assert len(forest) == 40 and all(t["size"][0] <= 64 for t in forest)
    scored = iso.score_forest(df, forest)
    top = {r.id for r in scored.orderBy(F.desc("score")).limit(3).collect()}
    assert top == {1000, 1001, 1002}
    assert scored.where("score <= 0 OR score > 1").count() == 0
    again = iso.score_forest(df, iso.fit_forest(df, iso.IsolationForest(trees=40, sample=64)))
    assert scored.agg(F.sum("score")).first()[0] == pytest.approx(again.agg(F.sum("score")).first()[0])


def test_ranking_metrics_by_hand(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 10, 1)], "userId long, itemId long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (1, 50), (2, 99), (4, 10)], "userId long, itemId long")
    rows = {r.userId: r for r in met.user_hits(recs, truth, 3).collect()}
    assert set(rows) == {1, 2}
    gain = 1 / math.log(3) + 1 / math.log(4)
    ideal = 1 / math.log(2) + gain
    assert rows[1].hit == 2 and rows[1].actual == 3 and rows[1].dcg == pytest.approx(gain)
    assert rows[1].idcg == pytest.approx(ideal) and rows[1].ap == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert rows[2].hit == 0 and rows[2].dcg == 0
    total = met.ranking_metrics(met.user_hits(recs, truth, 3), 3).first()
    assert total.n_users == 2 and total.ndcg == pytest.approx(gain / ideal / 2)


def test_cluster_complements_add_up(spark):
    per_user = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.0, 0.0), (3, 3.0, 4.0)], "userId long, dcg double, idcg double")
    clusters = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "userId long, cluster int")
    rows = {r.cluster: r for r in gv.diversity_by_cluster(per_user, clusters).collect()}
    assert rows[0].cluster_ndcg == 0.5 and rows[0].equiv_ndcg == 0.75
    assert rows[1].cluster_ndcg == 0.0 and rows[1].equiv_ndcg == pytest.approx(4 / 6)  # ideal of zero
    hits = spark.createDataFrame([(1, 1, 2, 1.0, 2.0)], "userId long, hit long, actual long, dcg double, idcg double")
    scored = {r.cluster: r for r in gv.accuracy_by_cluster(hits, clusters.where("userId < 3"), 10).collect()}
    assert scored[1].cluster_ndcg == 0.0 and scored[0].cluster_ndcg == 0.5


def test_auc_counts_ties_half(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "label int, score double")
    assert met.auc(scored).first().auc == pytest.approx(3.5 / 4)


def test_anti_rows_keep_duplicates_and_match_missing(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, 1.0), (2, 1.0)], "a int, b double")
    right = spark.createDataFrame([(1, None)], "a int, b double")
    assert [tuple(r) for r in rel.anti_rows(left, right).collect()] == [(2, 1.0), (2, 1.0)]
    assert rel.semi_rows(left, right).count() + rel.anti_rows(left, right).count() == left.count()


def test_group_swap_keeps_sizes(frame, spark):
    rows = [(u, i, 3) for u in range(12) for i in range(10)]
    ratings = frame(rows)
    train, test = ratings.where("itemId < 6"), ratings.where("itemId >= 6")
    members = spark.createDataFrame([(0,), (1,)], "userId long")
    new_train, new_test = sam.group_swap_split(train, test, members)
    assert new_train.count() == train.count() and new_test.count() == test.count()
    assert new_train.where("userId < 2").groupBy("userId").count().where("count <> 3").count() == 0
    assert new_train.select("userId", "itemId").intersect(new_test.select("userId", "itemId")).count() == 0


def test_scores_at_the_threshold_are_no_anomalies(spark):
    scored = spark.createDataFrame([(0.8,), (0.81,), (0.2,)], "score double")
    assert {r.anomaly: r.n for r in iso.anomaly_count(scored).collect()} == {0: 2, 1: 1}


def test_negatives_reach_a_catalogue_above_a_million(spark):
    from ratesift.operators import recommend

    items = spark.range(1_200_000).withColumnRenamed("id", "itemId")
    positives = spark.range(300).selectExpr("id AS instance", "id AS userId", "id * 3557 AS itemId")
    found = [r.itemId for r in recommend.negative_draws(positives, items, positives, 1).collect()]
    assert len(found) == 300 and max(found) > 1_100_000
