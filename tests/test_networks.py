"""Network training in shards: gradients, one shard against a plain loop,
several shards against one, stacked networks against single ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlag.functions.hashing import hash_bucket
from airlag.plans import mlp as N
from airlag.plans import tuning as TU

SHAPE = {"hidden": (6, 4), "activation": "relu", "alpha": 0.01, "learning_rate": 0.02}


def _rows(spark, n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((f"k{i}", a, b, float(a * b + 0.3 * a > 0), 2 * a - abs(b), i % 3, rng.choice([0.5, 1.0, 2.0])))
    return spark.createDataFrame(rows, "row_key string, a double, b double, y double, z double, fold int, w double")


@pytest.mark.parametrize("task,activation", [("classification", "relu"), ("regression", "tanh")])
def test_gradients_against_differences(task, activation):
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(7, 3)), (rng.random(7) > 0.5).astype(float), rng.random((2, 7))
    params = [rng.normal(size=s) for s in [(2, 3, 4), (2, 1, 4), (2, 4, 1), (2, 1, 1)]]
    _, grads = N._loss_grad(params, x, y, w, task, activation)
    for p, g in zip(params, grads):
        for at in np.ndindex(p.shape):
            keep, losses = p[at], []
            for d in (1e-6, -1e-6):
                p[at] = keep + d
                losses.append(N._loss_grad(params, x, y, w, task, activation)[0][at[0]])
            p[at] = keep
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5


def test_one_shard_is_the_plain_algorithm(spark):
    df = _rows(spark, 500)
    epochs, size, seed = 3, 64, 42
    [(got, history)], _ = N.train_networks(df, ["a", "b"], "y", "classification", [SHAPE], epochs, size,
                                           val_frac=0.0, weight_col="w", seed=seed)
    rows = df.select("a", "b", "y", "w", F.xxhash64(F.lit(seed), F.col("row_key")).alias("h")).orderBy("h").toPandas()
    x, y, w = rows[["a", "b"]].to_numpy(), rows["y"].to_numpy(), rows["w"].to_numpy()
    p = N._init([2, 6, 4, 1], seed)
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = np.random.default_rng([seed, epoch, 0, 0]).permutation(len(x))
        for k in range(0, len(x), size):
            at = order[k:k + size]
            h1 = np.maximum(x[at] @ p[0] + p[1], 0)
            h2 = np.maximum(h1 @ p[2] + p[3], 0)
            d3 = w[at, None] * (1 / (1 + np.exp(-(h2 @ p[4] + p[5]))) - y[at, None])
            d2 = (d3 @ p[4].T) * (h2 > 0)
            d1 = (d2 @ p[2].T) * (h1 > 0)
            grads = [x[at].T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ d3, d3.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                g = (g + (SHAPE["alpha"] * p[i] if i % 2 == 0 else 0)) / w[at].sum()
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - SHAPE["learning_rate"] * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m[i] / (np.sqrt(v[i]) + 1e-8)
    for a, b in zip(got, p):
        assert np.allclose(a, b, atol=1e-9)


def test_shards_and_steps_grow_with_the_rows():
    assert [N.shards_of(n) for n in (0, 1, 2048, 2049, 4 * 2048, 100 * 2048)] == [1, 1, 1, 2, 2, 10]


def test_more_shards_learn_as_well_as_one(spark, monkeypatch):
    # noisy classes: with an attainable least loss, where fewer steps one after
    # another in an epoch cost epochs, not quality
    df = _rows(spark, 3000).withColumn("y", (F.col("a") * F.col("b") + 0.3 * F.col("a") + F.randn(5) > 0).cast("double"))
    losses = []
    for rows in (10 ** 6, 100):
        monkeypatch.setattr(N, "SHARD_ROWS", rows)
        [(_, history)], _ = N.train_networks(df, ["a", "b"], "y", "classification", [SHAPE], 25, 50)
        losses.append(min(history))
    print(losses)
    assert losses[0] < 0.65 and losses[1] < losses[0] * 1.05


def test_stacked_networks_equal_single_ones_and_do_not_see_their_fold(spark):
    df = _rows(spark, 600)
    stats = ([0.1, -0.2], [1.5, 0.5])
    networks = [dict(SHAPE, alpha=a, activation=act, fold=f, stats=stats)
                for a in (0.0, 0.1) for act in ("relu", "tanh") for f in (0, 1)]
    together, sums = N.train_networks(df, ["a", "b"], "z", "regression", networks, 4, 40, fold_col="fold")
    changed = df.withColumn("z", F.when(F.col("fold") == 1, 100.0).otherwise(F.col("z")))
    alone, _ = N.train_networks(changed, ["a", "b"], "z", "regression", [networks[3]], 4, 40, fold_col="fold")
    for a, b in zip(together[3][0], alone[0][0]):
        assert np.allclose(a, b, atol=1e-9)
    pdf = df.where("fold = 1").toPandas()
    x = (pdf[["a", "b"]].to_numpy() - stats[0]) / stats[1]
    err = N._forward(together[3][0], x, "tanh")[-1][:, 0] - pdf["z"].to_numpy()
    assert sums[3][0] == len(pdf) and np.isclose(sums[3][1], (err * err).sum()) and np.isclose(sums[3][2], np.abs(err).sum())


def test_steps_do_not_depend_on_the_size_of_batches(spark):
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    df, before = _rows(spark, 700), spark.conf.get(key)
    try:
        for size in ("10000", "64"):
            spark.conf.set(key, size)
            found.append(N.train_networks(df, ["a", "b"], "y", "classification", [SHAPE], 4, 100)[0][0])
    finally:
        spark.conf.set(key, before)
    (p, losses), (q, others) = found
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(p, q)) and np.allclose(losses, others)


def test_patience_keeps_the_best_weights(spark):
    df = _rows(spark, 400)
    net = dict(SHAPE, learning_rate=0.5)
    [(params, history)], _ = N.train_networks(df, ["a", "b"], "z", "regression", [net], 60, 20, patience=3)
    tol = 1e-4 * df.agg(F.var_pop("z")).first()[0] / 2
    assert len(history) < 60
    val = df.where(hash_bucket("row_key", 44) < 1000).toPandas()
    err = N._forward(params, val[["a", "b"]].to_numpy(), "relu")[-1][:, 0] - val["z"].to_numpy()
    assert abs(0.5 * (err * err).mean() - min(history)) < tol + 1e-9


def test_empty_table_leaves_the_first_weights(spark):
    df = _rows(spark, 5).where("a > 100")
    model = N.train_mlp(df, ["a", "b"], "y", max_epochs=2, hidden=(3,))
    assert all(np.array_equal(a, b) for a, b in zip(model.params, N._init([2, 3, 1], 42)))


def test_grid_scores_every_candidate_on_every_fold(spark):
    df = _rows(spark, 900).withColumn("label", F.col("y"))
    grid = {"hidden": [(8,), (8, 4)], "activation": ["tanh"], "alpha": [1e-4, 1e-3], "learning_rate": [0.03]}
    rows = TU.grid_search_mlp(df, ["a", "b"], "classification", grid, max_epochs=25).orderBy("candidate").collect()
    assert len(rows) == 4 and all(len(r["fold_scores"]) == 3 for r in rows)
    assert max(r["mean_score"] for r in rows) > 0.8


@pytest.mark.parametrize("task,weight", [("classification", "w"), ("regression", None)])
def test_merged_rows_train_and_score_as_all_rows(spark, monkeypatch, task, weight):
    # 60 feature values in 1200 rows, one step an epoch: the same gradients whatever the rows are merged to
    df = _rows(spark, 1200).withColumn("a", F.floor(F.col("a")).cast("double")).withColumn("b", F.floor(F.col("b")).cast("double"))
    df = df.withColumn("z", F.col("z") + 1000)
    networks = [dict(SHAPE, fold=f, stats=([0.1, -0.2], [1.5, 0.5])) for f in (0, 1, 2)]
    found = []
    for rows in (10 ** 6, 2):
        monkeypatch.setattr(N, "MERGE_FROM", rows)
        found.append(N.train_networks(df, ["a", "b"], "y" if task == "classification" else "z", task, networks, 6, 10 ** 6,
                                      weight_col=weight, fold_col="fold"))
    (plain, of_rows), (merged, of_merged) = found
    for (p, losses), (q, others) in zip(plain, merged):
        assert all(np.allclose(a, b, atol=1e-7) for a, b in zip(p, q)) and np.allclose(losses, others, rtol=1e-7)
    assert np.allclose(of_rows[:, [0, 1, 3, 4]], of_merged[:, [0, 1, 3, 4]], rtol=1e-7) and np.isnan(of_merged[:, 2]).all()


def test_an_epoch_over_copies_costs_their_different_values(spark, monkeypatch):
    shards = []
    monkeypatch.setattr(N, "shards_of", lambda rows: shards.append(rows) or 1)
    df = _rows(spark, 300).crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    df = df.withColumn("row_key", F.concat("row_key", F.lit("-"), F.col("copy").cast("string")))
    [(_, history)], _ = N.train_networks(df, ["a", "b"], "z", "regression", [SHAPE], 30, 20)
    assert shards[0] <= 2 * 300  # training and held back
    assert history[-1] < 0.5 * history[0]
