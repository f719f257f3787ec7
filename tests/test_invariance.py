"""Same answers after repartitioning; guards and pattern tables."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from airlag.operators import metrics as M
from airlag.operators import profiling as P
from airlag.operators.joins import broadcast_if_bounded, row_count_at_most
from airlag.operators.splits import kfold_stratified, undersample_majority


def _frame(spark, n=4000, seed=9):
    rng = random.Random(seed)
    rows = [(f"k{i}", rng.randint(0, 1), round(rng.random(), 3),
             None if rng.random() < 0.1 else rng.randint(-60, 300),
             None if rng.random() < 0.05 else rng.choice(["A", "B", "C"])) for i in range(n)]
    return spark.createDataFrame(rows, "row_key string, y int, score double, delay int, cat string")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reports_and_metrics_ignore_partitioning(spark):
    a = _frame(spark)
    b = a.repartition(7)
    for fn in (lambda d: P.describe_numeric(d, ["delay", "score"]),
               lambda d: P.missing_cooccurrence(d),
               lambda d: P.column_profile(d),
               lambda d: P.value_counts(d, "cat"),
               lambda d: M.roc_auc(d, "y", "score"),
               lambda d: M.average_precision(d, "y", "score"),
               lambda d: M.ecdf(d, "delay")):
        assert _rows(fn(a)) == _rows(fn(b))


def test_folds_and_undersampling_ignore_partitioning(spark):
    a = _frame(spark)
    b = a.repartition(7)
    assert _rows(kfold_stratified(a, "y", k=3)) == _rows(kfold_stratified(b, "y", k=3))
    assert _rows(undersample_majority(a, "y")) == _rows(undersample_majority(b, "y"))


def test_null_patterns_match_direct_counts(spark):
    a = _frame(spark)
    pats = {r["mask"][0]: r["n_rows"] for r in P.null_patterns(a, ["delay", "cat"]).collect()}
    n_delay = a.where(F.col("delay").isNull()).count()
    n_both = a.where(F.col("delay").isNull() & F.col("cat").isNull()).count()
    assert sum(v for m, v in pats.items() if m & 1) == n_delay
    assert pats.get(3, 0) == n_both
    assert sum(pats.values()) == a.count()


def test_broadcast_guard(spark, capsys):
    small = spark.range(10)
    big = spark.range(5000)
    assert row_count_at_most(small, 10) and not row_count_at_most(small, 9)
    assert not row_count_at_most(big, 100)
    capsys.readouterr()
    big.join(broadcast_if_bounded(small, 100), "id").explain(extended=True)
    plan_small = capsys.readouterr().out.lower()
    small.join(broadcast_if_bounded(big, 100), "id").explain(extended=True)
    plan_big = capsys.readouterr().out.lower()
    assert "strategy=broadcast" in plan_small and "strategy=broadcast" not in plan_big


def test_reports_of_wide_tables(spark):
    """70 and 200 columns, most of them null: more than one word of the pattern."""
    for width in (70, 200):
        df = spark.range(5).select(*[(F.col("id") if i < 4 else F.when(F.col("id") == i % 7, F.col("id"))).alias(f"c{i}") for i in range(width)])
        nulls = sum(df.where(F.col(c).isNull()).count() > 0 for c in (f"c{i}" for i in range(0, width, 23)))
        prof = {r["column"]: r["n_null"] for r in P.column_profile(df).collect()}
        assert len(prof) == width and sum(prof[f"c{i}"] > 0 for i in range(0, width, 23)) == nulls
        assert P.quality_report(df).first()["n_cols_with_nulls"] == sum(n > 0 for n in prof.values()) == width - 4
        hist = P.missing_per_row_hist(df).collect()
        assert sum(r["n_rows"] for r in hist) == 5
        assert sum(r["n_missing"] * r["n_rows"] for r in hist) == sum(prof.values())


def test_exact_quantiles_and_modes(spark):
    from airlag.operators.exact_stats import exact_quantiles_many, modes
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"a": rng.integers(0, 50, 4000).astype(float), "b": rng.normal(size=4000), "c": np.nan, "s": rng.choice(list("xyz"), 4000)})
    data.loc[::7, "a"] = None
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in data.itertuples(index=False)],
                               "a double, b double, c double, s string")
    got = exact_quantiles_many(df, ["a", "b", "c"], [0, 0.1, 0.5, 0.999, 1])
    for c in "ab":
        assert np.allclose(got[c], data[c].dropna().quantile([0, 0.1, 0.5, 0.999, 1]))
    assert got["c"] == [None] * 5
    assert modes(df, ["s", "c"]) == {"s": data["s"].mode()[0], "c": None}
