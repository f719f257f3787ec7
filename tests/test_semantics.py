"""Hand-made edge frames for the pinned semantics."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlag import schema as S
from airlag.functions import calendar as C
from airlag.functions.targets import is_delayed
from airlag.operators import cleaning as CL
from airlag.operators import metrics as M
from airlag.operators import profiling as P
from airlag.operators.ordering import cumulative_sums
from airlag.operators.ranking import hash_rank
from airlag.operators.splits import split_stratified


def test_delay_threshold_is_strict(spark):
    df = spark.createDataFrame([(14,), (15,), (16,), (None,)], "d int")
    got = [r[0] for r in df.select(is_delayed("d")).collect()]
    assert got == [0, 0, 1, 0]


def test_calendar_flags(spark):
    dates = [dt.date(2024, 11, 21), dt.date(2024, 11, 22), dt.date(2024, 12, 19),
             dt.date(2024, 12, 20), dt.date(2025, 1, 5), dt.date(2025, 1, 6),
             dt.date(2024, 7, 7), dt.date(2024, 5, 25), dt.date(2024, 9, 8), None]
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    rows = df.select(C.is_holiday_period("d").alias("h"), C.season("d").alias("s"),
                     C.is_weekend("d").alias("w"), C.day_of_week("d").alias("dow")).collect()
    assert [r.h for r in rows] == [0, 1, 0, 1, 1, 0, 1, 1, 0, 0]
    assert rows[-1].s == "Fall" and rows[-1].w == 0
    assert rows[0].s == "Fall" and rows[2].s == "Winter" and rows[6].s == "Summer"
    # 2024-11-22 is a Friday -> 4 (Monday = 0)
    assert rows[1].dow == 4 and rows[1].w == 0


def test_invalid_rows_boundary(spark):
    cols = CL.critical_columns(spark.createDataFrame([], "flight_date date"))
    base = {c: 1 for c in S.RAW_COLS}
    def row(n_null):
        r = dict(base)
        for c in [c for c in cols if c != "flight_date"][:n_null]:
            r[c] = None
        return r
    schema = ", ".join(f"{c} string" for c in S.RAW_COLS)
    df = spark.createDataFrame([tuple(row(9)[c] for c in S.RAW_COLS),
                                tuple(row(10)[c] for c in S.RAW_COLS)], schema)
    df = df.withColumn("flight_date", F.lit(dt.date(2024, 1, 1)))
    assert CL.remove_invalid_rows(df).count() == 1


def test_mode_ties_and_unknown(spark):
    df = spark.createDataFrame(
        [("B", None, None, "x"), ("A", None, "12:00", "y"), (None, None, None, None),
         ("B", "N1", None, None), ("A", None, None, None)],
        "origin_airport string, tail_number string, sched_arr_time string, carrier_code string")
    out = CL.impute_categorical(df).collect()
    assert [r.origin_airport for r in out] == ["B", "A", "A", "B", "A"]  # tie -> smallest
    assert out[0].tail_number == "Unknown" and out[3].tail_number == "N1"
    assert out[0].sched_arr_time is None  # 'Time' columns skipped
    assert out[2].carrier_code == "x"


def test_all_null_categorical_becomes_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "origin_airport string")
    assert {r[0] for r in CL.impute_categorical(df).collect()} == {"Unknown"}


def test_median_fill_fractional_then_rounded(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,), (4,)], "taxi_in_min smallint")
    filled = CL.impute_numeric(df)
    assert [r[0] for r in filled.collect()] == [1.0, 2.0, 2.5, 3.0, 4.0]
    typed = CL.validate_types(filled)
    assert typed.schema["taxi_in_min"].dataType.simpleString() == "smallint"
    assert [r[0] for r in typed.collect()][2] == 3  # half up


def test_duplicates_with_nulls_are_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert CL.drop_duplicates(df).count() == 2
    assert P.count_duplicates(df).first().n_duplicates == 1


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "x", None), (1, None, None), (2, "x", None)], "a int, b string, c int")
    q = P.quality_report(df).first()
    assert q.n_constant_cols == 1 and q.n_cols_with_nulls == 2


def test_outlier_bounds_from_input(spark):
    df = spark.createDataFrame([(float(v), 0.0) for v in [1, 2, 3, 4, 100]] + [(None, 50.0)], "a double, b double")
    kept = CL.remove_outliers_iqr(df).collect()
    assert sorted(r.a for r in kept if r.a is not None) == [1, 2, 3, 4]
    assert all(r.b == 0.0 for r in kept)  # 50 is out for b (IQR 0)


def _auc_brute(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_ties_and_single_class(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.2, 0.3, 0.5, 0.7])) for _ in range(400)]
    df = spark.createDataFrame(pairs, "y int, score double")
    got = M.roc_auc(df, "y", "score").first().roc_auc
    assert abs(got - _auc_brute(pairs)) < 1e-6
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, score double")
    assert M.roc_auc(one, "y", "score").first().roc_auc is None


def test_average_precision_brute(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "y int, score double")
    got = M.average_precision(df, "y", "score").first()[0]
    P_ = sum(y for y, _ in pairs)
    ap = 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(1 for y, s in pairs if s >= t and y == 1)
        fp = sum(1 for y, s in pairs if s >= t and y == 0)
        pos_t = sum(1 for y, s in pairs if s == t and y == 1)
        ap += pos_t / P_ * tp / (tp + fp)
    assert abs(got - ap) < 1e-6


def test_cumulative_sums_match_pandas(spark):
    rng = random.Random(11)
    vals = [(rng.randint(-500, 500), rng.randint(0, 9)) for _ in range(3000)]
    df = spark.createDataFrame(vals, "v int, x int").groupBy("v").agg(F.sum("x").alias("x"))
    got = cumulative_sums(df, "v", ["x"]).toPandas().sort_values("v")
    pdf = pd.DataFrame(vals, columns=["v", "x"]).groupby("v", as_index=False)["x"].sum().sort_values("v")
    assert got["cum_x"].tolist() == pdf["x"].cumsum().tolist()
    desc = cumulative_sums(df, "v", ["x"], descending=True).toPandas().sort_values("v", ascending=False)
    assert desc["cum_x"].tolist() == pdf.sort_values("v", ascending=False)["x"].cumsum().tolist()


def test_hash_rank_with_a_hot_copied_row(spark):
    """One row copied to a third of the data goes through the chunked path
    and the ranks are still a permutation 1..n per group."""
    hot = [("hot", 1)] * 3000
    rest = [(f"k{i}", i % 2) for i in range(6000)]
    df = spark.createDataFrame(hot + rest, "key string, g int")
    r = hash_rank(df, ["g"], "key", buckets_per_partition=32)
    # force the heavy path with a small chunk
    from airlag.operators import ranking as R
    g = R.hash_rank_distinct(R.collapse_copies(df), ["g"], "key", buckets_per_partition=32)
    heavy = R.expand_copies(g, chunk=700).drop("_m", "_start", "_end")
    for frame in (r, heavy):
        pdf = frame.toPandas()
        for grp, sub in pdf.groupby("g"):
            assert sorted(sub["_rank"].tolist()) == list(range(1, len(sub) + 1))


def test_stratified_split_exact_and_partition_free(spark):
    rows = [(f"r{i}", int(i % 7 == 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "row_key string, y int")
    a = split_stratified(df, "y").groupBy("y", "split").count().collect()
    counts = {(r.y, r.split): r["count"] for r in a}
    n1 = sum(1 for _, y in rows if y == 1)
    assert counts[(1, "test")] == round(0.2 * n1)
    s1 = {r.row_key for r in split_stratified(df, "y").where("split = 'test'").collect()}
    s2 = {r.row_key for r in split_stratified(df.repartition(7), "y").where("split = 'test'").collect()}
    assert s1 == s2


def test_shape_moments_bias_corrected(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 9.0, 4.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = P.shape_moments(df, "x").first()
    s = pd.Series(vals)
    assert math.isclose(r.skewness, round(s.skew(), 6), abs_tol=1e-6)
    assert math.isclose(r.kurtosis, round(s.kurt(), 6), abs_tol=1e-6)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from airlag.operators.ordering import exact_quantiles
    rng = random.Random(2)
    vals = [rng.gauss(0, 1) for _ in range(2001)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
    want = np.quantile(np.array(vals), [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
    assert np.allclose(got, want, rtol=0, atol=1e-12)
