"""A representative slice of the registered queries against their DuckDB
twins on the smallest driver tables (the full set: tools/check_oracles.py)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle import compare

KEYS = [
    "combine_monthly_csv", "canonical_date", "basic_features", "select_features",
    "remove_invalid_rows", "handle_missing", "drop_duplicates", "preprocess",
    "preprocess_regression", "cap_outliers_iqr", "remove_outliers_iqr", "column_profile",
    "describe_numeric", "missing_cooccurrence", "quality_report", "distinct_counts",
    "value_counts", "shape_moments", "histogram", "ecdf", "box_stats", "subsample_n",
    "split_stratified", "kfold_stratified", "undersample_majority", "standard_scale",
    "regression_metrics", "classification_report", "roc_auc", "roc_curve",
    "average_precision", "model_comparison", "load_xy",
]


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck_small, key):
    df = E.queries()[key](spark, SF_SMALL)
    assert compare(df, duck_small, E.oracle_sql()[key]) == []


def test_every_query_has_callable_and_sql_keys_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 120


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["season"] for r in rows} <= {"Winter", "Spring", "Summer", "Fall"}
    assert df.columns == ["season", "mean_delay", "n_flights"]
