"""A cross-section of the registered queries against their SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_point  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

NAMES = [
    "a11_ordered_id_digest", "b12_form_errors", "c2_text_hash", "c14_quantile_band", "d11_error_free_sentences", "d19_tree_depth",
    "e4_nearest_pairs", "f3_stratified_folds", "f9_quota_sample", "g13_fixed_by_new", "h16_acceptance", "h17_queue_metrics",
    "h20_sensitivity_grid", "h24_subgroup_table", "i6_fold_queue", "j5_stability_verdict", "j10_auroc", "k5_pooled_tail",
    "k10_cluster_bootstrap", "l1_ridge", "m1_pair_agreement",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf, duck, name):
    df = entry_point.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


def test_entry_and_registry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
