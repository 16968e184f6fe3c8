"""A cross-section of the registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
KEYS = ("a6_read_trust", "c7_anti_rows", "d20_dense_index", "e5_stratified_split", "f11_group_swap_split", "i1e_nf1",
        "i2g_rnd_mean", "i3b_nf3", "i4e_nf4", "j3_label", "m4_layer3_result", "n5_silhouette_samples", "n9_trust_components",
        "p11_diversity_ndcg", "q3_group_validation", "r3_propagation", "r8_negative_draws", "r9_histories")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    assert compare(entry.queries()[key](spark, FOLDER), con, entry.oracle_sql()[key]) == "ok"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
