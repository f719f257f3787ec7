"""Fits on rows merged by what the method can tell apart."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from airlag.plans import boosting as BO


def _frame(spark, n, copies=1):
    i = F.col("id")
    x = F.array((i % 7).cast("double"), (i % 5).cast("double"))
    df = spark.range(n).select(array_to_vector(x).alias("features"), ((i % 7 > 3).cast("int") * 10 + i % 5).cast("double").alias("label"),
                               (i % 11 == 0).alias("held"))
    return df.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c")


def test_equal_rows_are_one_with_a_count(spark):
    df = _frame(spark, 5000).withColumns({"x": F.array(F.col("label"), F.lit(float("nan"))), "weight": F.lit(2.0)})
    rows = BO.distinct_rows(df, [np.array([-np.inf, 3.0, 8.0]), np.array([-np.inf])], 1)
    want = {(r.label, r.held): r.n for r in df.groupBy("label", "held").agg(F.count("*").alias("n")).collect()}
    got = {(r.y, r.held): r.n for r in rows.collect()}
    assert got == want and rows.count() == len(want)
    assert {bytes(r.bins) for r in rows.collect()} <= {bytes([b, 0]) for b in range(4)}


def test_boosting_does_not_grow_with_copies(spark):
    config = {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0}
    one, many = (BO.fit_boosted(_frame(spark, 770, c), "regression", config, "held") for c in (1, 50))
    assert abs(one.losses[-1] - many.losses[-1]) < 0.35 and many.losses[-1] < 1.5
    frame = _frame(spark, 20_000, 1).withColumns({"x": F.array(F.col("label"), F.col("label")), "weight": F.lit(1.0)})
    assert BO.blocks(BO.distinct_rows(frame, [np.array([-np.inf, 3.0])] * 2, 1), 2).count() <= 2


def test_draws_repeat_and_have_the_share(spark):
    count = np.full(1000, 40)
    a = BO.drawn_of(77, count, 3, 0.8)
    assert (a == BO.drawn_of(77, count, 3, 0.8)).all() and (a <= 40).all()
    assert abs(a.mean() / 40 - 0.8) < 0.01 and (a != BO.drawn_of(77, count, 4, 0.8)).any()


def test_search_on_merged_rows_equals_one_on_all(spark):
    from airlag.plans import tuning as T
    i = F.col("id")
    df = spark.range(1200).select(F.col("id").cast("string").alias("row_key"), (i % 6).cast("double").alias("a"), (i % 4).cast("double").alias("b"),
                                  ((i % 6 + i * 7919 % 10) > 7).cast("double").alias("label"), (F.floor(i / 24) % 2).cast("int").alias("fold"))
    merged = T.merged_rows(df, ["a", "b"])
    assert merged.count() < 100 and merged.agg(F.sum("copies")).first()[0] == 1200
    found = [{"C": 0.1, "class_weight": w, "penalty": "l2"} for w in (None, "balanced")]
    for score in (T.f1_score, T.average_precision_score):
        one, all_rows = (T.cross_validate(df, ["a", "b"], found, T._fit_lr, score, scale=True, merge=m).collect() for m in (True, False))
        assert np.allclose([r["mean_score"] for r in one], [r["mean_score"] for r in all_rows], atol=1e-3)
