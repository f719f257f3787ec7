"""Forests on rows merged by bins."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from airlag.plans import boosting as BO
from airlag.plans import estimators as E
from airlag.plans import forest as FO


def _frame(spark, n, copies=1):
    """Label: 10 if a > 3, plus b; yes if a > 3 and b > 1; c is noise."""
    i = F.col("id")
    a, b, c = i % 7, i % 5, F.pmod(F.xxhash64("id"), F.lit(3))
    df = spark.range(n).select(
        array_to_vector(F.array(*[x.cast("double") for x in (a, b, c)])).alias("features"),
        ((a > 3).cast("int") * 10 + b).cast("double").alias("amount"), ((a > 3) & (b > 1)).cast("double").alias("yes"))
    return df.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c")


def test_a_forest_stores_distinct_rows_only(spark, monkeypatch):
    stored, blocks = [], BO.blocks
    monkeypatch.setattr(BO, "blocks", lambda rows, tasks: stored.append(rows.count()) or blocks(rows, tasks))
    for copies in (1, 30):
        model = E.rf_regressor(_frame(spark, 700, copies).withColumnRenamed("amount", "label"), 4, 6)
        roots = [t["cover"][0] for t in model.trees]
        assert all(abs(n / (700 * copies) - 1) < 0.2 for n in roots) and len(set(roots)) > 1  # each tree draws its rows
    assert stored[0] == stored[1] <= 7 * 5 * 3


def test_a_regression_forest_learns_and_is_read_back(spark, tmp_path):
    df = _frame(spark, 2000).withColumnRenamed("amount", "label")
    model = E.rf_regressor(df, 12, 8, min_samples_leaf=5)
    errors = model.transform(df).select(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    assert errors < 0.2
    importance = model.featureImportances.toArray()
    assert abs(importance.sum() - 1) < 1e-9 and importance.argmax() == 0 and importance[2] < 0.02
    for t in model.trees:
        assert t["cover"].min() >= 5
        inner = np.flatnonzero(t["feature"] >= 0)
        assert np.allclose(t["cover"][inner], t["cover"][t["left"][inner]] + t["cover"][t["left"][inner] + 1])
    model.save(str(tmp_path / "forest"))
    again = FO.Forest.load(str(tmp_path / "forest"))
    pairs = zip(model.transform(df).collect(), again.transform(df).collect(), strict=True)
    assert all(a["prediction"] == b["prediction"] for a, b in pairs)


def test_a_forest_of_two_classes_with_weights(spark):
    df = _frame(spark, 3000).withColumnRenamed("yes", "label")
    model = E.rf_classifier(df, 12, 10, min_samples_leaf=3, class_weight="balanced")
    got = E.predict(model, df).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")), F.min("p1"), F.max("p1")).first()
    assert got[0] > 0.98 and 0 <= got[1] < 0.3 and 0.7 < got[2] <= 1
    stump = E.rf_classifier(df, 2, 0)
    assert [len(t["feature"]) for t in stump.trees] == [1, 1]


def test_the_split_of_most_gain(spark):
    rows = [(0, 0, 0, 1, 5.0, 5.0, 5.0), (0, 0, 0, 2, 5.0, 50.0, 500.0), (0, 0, 1, 1, 1.0, 1.0, 1.0), (0, 0, 1, 2, 9.0, 54.0, 504.0)]
    sums = spark.createDataFrame(rows, "tree int, node long, feature int, bin int, n double, a double, q double")
    [best] = FO._best_splits(sums, "regression", 1).collect()
    assert (best.feature, best.bin, best.ln, best.rn) == (0, 1, 5.0, 5.0) and abs(best.gain - 202.5) < 1e-9
    assert FO._best_splits(sums, "regression", 6).count() == 0
