"""Steps that several parts of a result read are computed once: the results read their written tables."""

from types import SimpleNamespace

import pytest

from ratesift.operators import metrics
from ratesift.plans import aggregates, evaluation, relational, tables
from ratesift.session import durable
from ratesift.sources import views


@pytest.fixture()
def t(spark, frame):
    rows = [(u, (u * 7 + i * 3) % 23, (u * i) % 10 / 2 + 0.5) for u in range(1, 9) for i in range(23)]
    items = spark.createDataFrame([(i, f"t{i}", f"g{i % 3}|h{i % 2}") for i in range(23)], "itemId long, title string, genres string")
    users = spark.createDataFrame([(u,) for u in range(1, 9)], "userId long")
    return SimpleNamespace(stored=durable(frame(rows), "ratings"), items=items, users=users)


def read(df):
    return {name.split("/ratesift/")[1].split("-")[0] for name in df.inputFiles() if "/ratesift/" in name}


def test_tier_medians_read_written_tiers(t):
    found = aggregates.tier_medians(t)
    assert "ratings" not in read(found) and found.count() > 0


def test_clean_view_reads_written_flags(t):
    found = relational.clean_view(t)
    assert read(found) == {"flags"} and found.count() > 0


def test_before_and_after_read_written_recommendations(t):
    found = evaluation.before_and_after(t)
    assert read(found) == {"recs", "split"} and found.count() > 0


def test_diversity_reads_written_likelihood(t):
    found = evaluation.diversity_ndcg(t)
    assert "likelihood" in read(found) and "ratings" not in read(found) and found.count() > 0


def test_diversity_of_clusters_reads_written_users(t):
    for plan in (evaluation.cluster_diversity, evaluation.change):
        found = plan(t)
        assert read(found) == {"diversity"} and found.count() > 0


def test_likelihood_table_counts_genres_of_written_pairs(t, spark, monkeypatch):
    seen = []
    plain = metrics.genre_likelihood
    monkeypatch.setattr(tables.metrics, "genre_likelihood", lambda ratings, items: seen.append(ratings) or plain(ratings, items))
    found = tables.likelihood_table(SimpleNamespace(spark=spark, ratings=t.stored, items=t.items))
    assert read(seen[0]) == {"rated"} and seen[0].columns == ["userId", "itemId"]
    wanted = {(r.userId, r.genre): round(r.likelihood, 6) for r in plain(t.stored, t.items).collect()}
    assert {(r.userId, r.genre): r.likelihood for r in found.collect()} == wanted


def test_latest_rating_holds_each_column_once(spark):
    log = spark.createDataFrame([(1, 2, 10, 5, 1, 0.5), (1, 2, 10, 5, 2, 1.0), (1, 2, 9, 9, 9, 2.0), (1, 3, None, 1, 1, 4.0)],
                                "userId long, itemId long, ts long, l_orderkey long, l_linenumber long, rating double")
    latest = views.latest_rating(log, ["ts", "l_orderkey", "l_linenumber"])
    assert {tuple(r) for r in latest.collect()} == {(1, 2, 1.0, 10), (1, 3, 4.0, None)}
    assert latest.columns == ["userId", "itemId", "rating", "ts"]
