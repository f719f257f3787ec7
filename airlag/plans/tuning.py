"""Hyper-parameter search on hash-assigned folds.

Folds come from ``kfold_stratified`` (a ``fold`` column), so fold membership
is the same on every run.  For every fold the scaler and the class weights are
fitted on the other folds' rows only, the scaled frame is stored once, and the
candidates are fitted on it, several at a time; each fit is a distributed job.
Random search draws its candidates on the driver from a seeded generator.
"""

from __future__ import annotations

import json
import math
import random
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlag.operators import metrics as M
from airlag.plans import estimators as E
from airlag.plans.mlp import BATCH_ROWS, train_networks
from airlag.plans.scaling import standard_scale
from airlag.session import cut_lineage

# --- fixed values: published search spaces ----------------------------------
LR_GRID = {"C": [0.001, 0.01, 0.1, 1, 10], "penalty": ["l1", "l2"],
           "class_weight": [None, "balanced"]}
LR_RANDOM = {"C_loguniform": (1e-4, 1e2), "class_weight": [None, "balanced"], "n_iter": 20}
LR_MAX_ITER = 10_000
#: Merged rows for which a task of a fit is worth its start.
FIT_ROWS = 100_000
RF_REG_RANDOM = {"n_estimators": [150, 250, 400], "max_depth": [None, 15, 25, 35],
                 "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4, 8], "max_features": ["sqrt"]}
BOOSTED_RANDOM = {"n_estimators": (500, 2000), "learning_rate": (0.01, 0.31), "subsample": (0.6, 1.0),
                  "colsample_bytree": (0.6, 1.0), "scale_pos_weight": (1.0, 6.0), "n_iter": 25,
                  "early_stopping_rounds": 25}
MLP_DEFAULT = {"hidden": (100, 50), "activation": "relu", "alpha": 0.0001, "learning_rate": 0.001}
MLP_GRID_CLF = {"hidden": [(50,), (50, 100)], "activation": ["relu"], "alpha": [0.0001, 0.001], "learning_rate": [0.001]}
MLP_GRID_REG = {"hidden": [(32,), (50,), (32, 16), (50, 25)], "activation": ["relu", "tanh"], "alpha": [0.0001, 0.001, 0.01],
                "learning_rate": [0.001, 0.01]}
MLP_GRID_EPOCHS, MLP_GRID_PATIENCE = 300, {"classification": 10, "regression": 20}
BOOSTED_DEPTH = {"regression": (3, 10), "classification": (3, 8)}
# ----------------------------------------------------------------------------


def cross_validate(train: DataFrame, features: list[str], candidates: list[dict], fit, score, label: str = "label",
                   scale: bool = False, assemble: bool = True, parallelism: int = 4, merge: bool = False) -> DataFrame:
    """``candidate, params, mean_score, fold_scores``, a row per candidate.

    ``train`` has the raw features, ``label``, ``fold`` and ``row_key``;
    ``fit(frame, candidate)`` returns a model, ``score(model, frame)`` a number.
    ``merge``: both take rows with a number of ``copies``."""
    train = cut_lineage(merged_rows(train, features, label) if merge else train, "folded")
    copies = "copies" if merge else None
    folds = sorted(r[0] for r in train.select("fold").distinct().collect())  # one row per fold
    scores: list[list[float]] = [[] for _ in candidates]
    for f in folds:
        frame = train
        if scale:
            frame, _ = standard_scale(frame, features, fit_filter=F.col("fold") != f, copies=copies)
        if assemble:
            frame = E.prepare(frame, features, label, keep=("copies" if merge else "row_key", "fold"))
        else:
            frame = cut_lineage(frame, "fold")
        if merge:  # small by now: partitions that are worth a task in each pass of each fit
            frame = cut_lineage(frame.coalesce(max(1, min(frame.rdd.getNumPartitions(), -(-frame.count() // FIT_ROWS)))), "fold")
        rest, held = frame.where(F.col("fold") != f), frame.where(F.col("fold") == f)
        with ThreadPool(parallelism) as pool:
            for i, s in enumerate(pool.map(lambda c: float(score(fit(rest, c), held)), candidates)):  # noqa: B023
                scores[i].append(s)
    rows = [(i, json.dumps(c, sort_keys=True), sum(s) / len(s), s)
            for i, (c, s) in enumerate(zip(candidates, scores, strict=True))]
    return train.sparkSession.createDataFrame(
        rows, "candidate int, params string, mean_score double, fold_scores array<double>")


def f1_score(model, held: DataFrame, label: str = "label") -> float:
    n = F.col("copies") if "copies" in held.columns else F.lit(1.0)
    p = model.transform(held).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"), n.alias("n"))
    c = p.agg(F.sum(F.when((F.col("y") == 1) & (F.col("yhat") == 1), F.col("n"))).alias("tp"),
              F.coalesce(F.sum(F.when(F.col("y") != F.col("yhat"), F.col("n"))), F.lit(0.0)).alias("wrong")).first()
    return 2 * c["tp"] / (2 * c["tp"] + c["wrong"]) if c["tp"] else 0.0


def average_precision_score(model, held: DataFrame) -> float:
    n = F.col("copies") if "copies" in held.columns else F.lit(1)
    scored = model.transform(held).select(F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"),
                                          n.cast("long").alias("n"))
    return M.average_precision(scored, "y", "score", "n").first()[0] or 0.0


def error_score(kind: str):
    """Negative rmse, mae or mse, so that larger is better."""
    def score(model, held: DataFrame, label: str = "label") -> float:
        e = F.col(label).cast("double") - F.col("prediction")
        r = model.transform(held).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")).first()
        return -(math.sqrt(r["mse"]) if kind == "rmse" else r[kind])
    return score


def merged_rows(train: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """A row for all of equal features, label and fold, with their number as
    ``copies``: a penalised likelihood and its scores see no more of a row."""
    return train.groupBy(*features, label, "fold").agg(F.count(F.lit(1)).cast("double").alias("copies"))


def _fit_lr(rest: DataFrame, c: dict):
    # regParam uses the weight sum of these rows; see estimators.logistic_regression
    return E.logistic_regression(rest, C=c["C"], penalty=c.get("penalty", "l2"), class_weight=c["class_weight"], max_iter=LR_MAX_ITER)


def grid_search_lr(train: DataFrame, features: list[str], grid: dict = LR_GRID, parallelism: int = 4) -> DataFrame:
    """C x penalty x class weight, scored by F1 of class 1."""
    found = [{"C": c, "penalty": p, "class_weight": w} for c in grid["C"] for p in grid["penalty"] for w in grid["class_weight"]]
    return cross_validate(train, features, found, _fit_lr, f1_score, scale=True, parallelism=parallelism, merge=True)


def random_search_lr(train: DataFrame, features: list[str], space: dict = LR_RANDOM, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """Log-uniform C and class weight, scored by average precision."""
    rng = random.Random(seed)
    lo, hi = (math.log(x) for x in space["C_loguniform"])
    found = [{"C": math.exp(rng.uniform(lo, hi)), "class_weight": rng.choice(space["class_weight"])} for _ in range(space["n_iter"])]
    return cross_validate(train, features, found, _fit_lr, average_precision_score, scale=True, parallelism=parallelism, merge=True)


def random_search_rf_regressor(train: DataFrame, features: list[str], n_iter: int, space: dict = RF_REG_RANDOM,
                               seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Random forest candidates scored by RMSE.  Spark bounds depth by 30 and
    knows the least rows of a child only: the candidate carries the depth that
    is fitted, and a node of ``min_samples_split`` rows is guaranteed by
    children of half as many."""
    rng, found = random.Random(seed), []
    for _ in range(n_iter):
        c = {k: rng.choice(v) for k, v in space.items()}
        c["fitted_depth"] = E.SPARK_MAX_DEPTH if c["max_depth"] is None else min(c["max_depth"], E.SPARK_MAX_DEPTH)
        found.append(c)
    fit = lambda rest, c: E.rf_regressor(
        rest, c["n_estimators"], c["fitted_depth"], max(c["min_samples_leaf"], -(-c["min_samples_split"] // 2)), c["max_features"], seed)
    return cross_validate(train, features, found, fit, error_score("rmse"), parallelism=parallelism)


def random_search_boosted(train: DataFrame, features: list[str], task: str, space: dict = BOOSTED_RANDOM, seed: int = 42,
                          parallelism: int = 2) -> DataFrame:
    """Boosted trees, 25 draws, scored by MAE or F1; early stopping on a tenth
    of the fitted rows, by a hash of the key."""
    from airlag.functions.hashing import hash_bucket
    rng, found = random.Random(seed), []
    for _ in range(space["n_iter"]):
        c = {"n_estimators": rng.randrange(*space["n_estimators"]), "max_depth": rng.randrange(*BOOSTED_DEPTH[task]),
             **{k: rng.uniform(*space[k]) for k in ("learning_rate", "subsample", "colsample_bytree")},
             "early_stopping_rounds": space["early_stopping_rounds"]}
        if task == "classification":
            c["scale_pos_weight"] = rng.uniform(*space["scale_pos_weight"])
        found.append(c)

    def fit(rest, c):
        frame = rest.withColumn("is_val", hash_bucket("row_key", 7) < 1000)
        if task == "classification":
            frame = frame.withColumn("weight", F.when(F.col("label") == 1, c["scale_pos_weight"]).otherwise(1.0))
        return E.boosted(frame, task, dict(c, eval_metric="mae" if task == "regression" else "logloss"), validation_col="is_val")

    return cross_validate(train, features, found, fit, error_score("mae") if task == "regression" else f1_score, parallelism=parallelism)


def grid_search_mlp(train: DataFrame, features: list[str], task: str, grid: dict[str, list], label: str = "label",
                    max_epochs: int = 300, patience: int = 10, weight_col: str | None = None) -> DataFrame:
    """Networks over every combination of ``grid`` (``hidden``, ``activation``,
    ``alpha``, ``learning_rate``), scored by F1 of class 1 or negative MSE; the
    columns of ``cross_validate``.

    All candidates of all folds train in the same passes over the rows and are
    scored in one more.  Each scales its inputs by the rows of the folds it learns
    from; a step takes so many rows of all folds that about the published batch
    is left for a candidate."""
    found = [{}]
    for name, values in grid.items():
        found = [{**c, name: v} for c in found for v in values]
    folds = sorted(r[0] for r in train.select("fold").distinct().collect())  # one row per fold
    frame = cut_lineage(train, "fold")
    stats = {}
    for f in folds:
        scaler = standard_scale(frame, features, fit_filter=F.col("fold") != f)[1]
        stats[f] = tuple([float(scaler[c][i]) for c in features] for i in (0, 1))
    networks = [dict(MLP_DEFAULT, **c, fold=f, stats=stats[f]) for c in found for f in folds]
    batch = round(BATCH_ROWS * len(folds) / max(len(folds) - 1, 1))
    _, sums = train_networks(frame, features, label, task, networks, max_epochs, batch, patience=patience,
                             weight_col=weight_col, fold_col="fold")
    rows = []
    for i, c in enumerate(found):
        of = sums[i * len(folds):(i + 1) * len(folds)]
        scores = [float(2 * tp / (2 * tp + wrong)) if tp else 0.0 for _, _, _, tp, wrong in of] if task == "classification" \
            else [float(-sq / n) for n, sq, *_ in of]
        rows.append((i, json.dumps(c, sort_keys=True), sum(scores) / len(scores), scores))
    return train.sparkSession.createDataFrame(
        rows, "candidate int, params string, mean_score double, fold_scores array<double>")
