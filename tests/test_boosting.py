"""Histogram boosting against a plain booster that tries every split."""

import random

import numpy as np
import pytest

from airlag.plans import boosting
from airlag.plans import estimators as E


def _rows(n=700, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(10), rng.randrange(8), rng.randrange(6)
        y = 3.0 * (a > 4) + (b % 3) * (c > 2) + rng.gauss(0, 0.5)
        out.append((float(a), float(b), float(c), y, 1.0 + i % 3, i % 5 == 0))
    return out


def _frame(spark, rows, classes):
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, weight double, is_val boolean").repartition(3)
    if classes:
        df = df.withColumn("y", (df.y > 2).cast("double"))
    return E.assembler(["a", "b", "c"]).transform(df).withColumnRenamed("y", "label")


def brute(x, y, w, rounds, depth, rate, classes):
    """Scores after all rounds, and each tree's splits, level by level."""
    mean = (y * w).sum() / w.sum()
    score = np.full(len(y), np.log(mean / (1 - mean)) if classes else mean)
    splits = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = (w * (p - y), w * p * (1 - p)) if classes else (w * (score - y), w)
        leaf = lambda r, g=g, h=h: -g[r].sum() / (h[r].sum() + 1) * rate
        half = lambda r, g=g, h=h: g[r].sum() ** 2 / (h[r].sum() + 1)
        level, found, step = [np.arange(len(y))], [], np.zeros(len(y))
        for _ in range(depth):
            below = []
            for rows in level:
                best = (1e-9, None)
                for f in range(x.shape[1]):
                    for t in np.unique(x[:, f]):
                        le, ri = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                        if len(le) and len(ri) and min(h[le].sum(), h[ri].sum()) >= 1:
                            gain = 0.5 * (half(le) + half(ri) - half(rows))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, float(t), le, ri))
                if best[1] is None:
                    step[rows] = leaf(rows)
                else:
                    found.append(best[1][:2])
                    below += best[1][2:]
            level = below
        for rows in level:
            step[rows] = leaf(rows)
        score = score + step
        splits.append(found)
    return score, splits


@pytest.mark.parametrize("classes", [False, True])
def test_splits_and_scores_equal_brute_force(spark, classes):
    rows = _rows()
    config = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0}
    model = boosting.fit_boosted(_frame(spark, rows, classes), "classification" if classes else "regression", config)
    x, w = np.array([r[:3] for r in rows]), np.array([r[4] for r in rows])
    y = np.array([float(r[3] > 2) if classes else r[3] for r in rows])
    score, splits = brute(x, y, w, 4, 3, 0.3, classes)
    assert np.allclose(model.scores(x), score)
    for tree, want in zip(model.trees, splits, strict=True):
        inner = tree["feature"] >= 0
        assert list(zip(tree["feature"][inner].tolist(), tree["border"][inner].tolist(), strict=True)) == want
    assert model.losses == [] and model.best_iteration == 3


def test_held_back_rows_end_the_training(spark, tmp_path):
    rows = _rows(1500, 9)
    df = _frame(spark, rows, False)
    config = {"n_estimators": 200, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.7,
              "early_stopping_rounds": 5, "eval_metric": "mae"}
    model = boosting.fit_boosted(df, "regression", config, "is_val")
    assert 0 < model.best_iteration == int(np.argmin(model.losses)) and model.rounds == model.best_iteration + 6 < 200
    held = [r for r in rows if r[5]]
    error = np.abs(model.scores(np.array([r[:3] for r in held])) - np.array([r[3] for r in held])).mean()
    assert abs(error - model.best_score) < 1e-9 and error < 0.5
    again = boosting.fit_boosted(df, "regression", config, "is_val")
    assert again.losses == model.losses
    model.save(str(tmp_path / "m"))
    loaded = boosting.BoostedTrees.load(str(tmp_path / "m"))
    a, b = (m.transform(df).orderBy("a", "b", "c", "label").toPandas()["prediction"].to_numpy() for m in (model, loaded))
    assert np.array_equal(a, b) and loaded.rounds == model.rounds
    used = E.importance_by_type(model, ["a", "b", "c"], str(tmp_path / "i")).collect()
    assert sum(r["split_count"] for r in used) == sum(int((t["feature"] >= 0).sum()) for t in model.trees)


def test_missing_values_and_no_rows(spark):
    rows = [(None, 1.0, 0.0, 5.0, 1.0, False), (float("nan"), 2.0, 0.0, 5.0, 1.0, False)] * 10 + [(3.0, 1.0, 0.0, 1.0, 1.0, False)] * 20
    config = {"n_estimators": 20, "max_depth": 2, "learning_rate": 0.5, "subsample": 1.0, "colsample_bytree": 1.0}
    model = boosting.fit_boosted(_frame(spark, rows, False), "regression", config)
    got = model.scores(np.array([[np.nan, 1.0, 0.0], [3.0, 1.0, 0.0]]))
    assert got[0] > 4.5 and got[1] < 1.5
    with pytest.raises(ValueError):
        boosting.fit_boosted(_frame(spark, rows, False).limit(0), "regression", config)
