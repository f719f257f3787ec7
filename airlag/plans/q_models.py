"""Registered queries: estimators, inspection, tuning, persistence (§2.9,
§2.11, model-related sinks).  Fits are not SQL-expressible: rows-only checks,
except ``load_xy`` which is a projection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from airlag.functions.hashing import hash_bucket
from airlag.operators import metrics as M
from airlag.operators.splits import kfold_stratified, split_random
from airlag.plans import base as B
from airlag.plans import estimators as E
from airlag.plans import sqlbase as Q
from airlag.plans.mlp import MLPModel, train_mlp
from airlag.plans.q_prep import ENGINEERED_CTE
from airlag.plans.q_profile import ENG_FEATURES
from airlag.plans.registry import query
from airlag.plans.scaling import standard_scale
from airlag.plans import tuning as TU
from airlag.plans.tuning import grid_search_lr, random_search_lr
from airlag.sources import sinks as SK
from airlag.sources.csv_ingest import scratch_path

W = Q.with_ctes
FEATS = ENG_FEATURES
#: The registered boosted queries run the published tuned configurations; the
#: patience on the held-back rows ends the fit.
BOOSTED_CLF = E.BOOSTED_TUNED_CLF
BOOSTED_REG = dict(E.BOOSTED_TUNED_REG, eval_metric="mae")


def model_frame(spark, sf, regression=False, scale=False, validation=False):
    """Engineered rows with row key, hash split (and a validation third inside
    train) -> assembled, checkpointed frame."""
    e = split_random(B.engineered_keyed(spark, sf, regression))
    if validation:
        e = e.withColumn("is_val", (F.col("split") == "train") & (hash_bucket("row_key", 7) < 1000))
    keep = ("row_key", "split") + (("is_val",) if validation else ())
    if scale:
        e, _ = standard_scale(e, FEATS, fit_filter=F.col("split") == "train")
    label = "arr_delay_min" if regression else "is_delayed"
    return E.prepare(e, FEATS, label, keep=keep)


def _cls_eval(pred, score_col="p1"):
    p = pred.select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"),
                    F.col(score_col).alias("score"), "split")
    m = M.classification_metrics(p, "y", "yhat", by=["split"])
    auc = M.roc_auc(p.where(F.col("split") == "test"), "y", "score").select("roc_auc")
    return m.where(F.col("split") == "test").crossJoin(auc)


def _reg_eval(pred):
    p = pred.select(F.col("label").alias("y"), F.col("prediction").alias("yhat"), "split")
    r = M.regression_metrics(p, "y", "yhat", by=["split"])
    t = M.within_tolerance(p, "y", "yhat", by=["split"])
    return r.join(t, "split").where(F.col("split") == "test")


# ----------------------------------------------------------------- §2.9

@query("load_xy", W(ENGINEERED_CTE) + "SELECT " + ", ".join(FEATS) + ", is_delayed FROM eng")
def q_load_xy(spark, sf):
    df, _, _ = E.load_xy(B.engineered(spark, sf), "classification")
    return df


@query("logistic_regression")
def q_logistic_regression(spark, sf):
    d = model_frame(spark, sf, scale=True)
    model = E.logistic_regression(d.where(F.col("split") == "train"), C=1.0, penalty="l2",
                                  class_weight="balanced")
    return _cls_eval(E.predict(model, d))


@query("rf_classifier")
def q_rf_classifier(spark, sf):
    d = model_frame(spark, sf)
    model = E.rf_classifier(d.where(F.col("split") == "train"), n_estimators=50, max_depth=20,
                            min_samples_leaf=10, class_weight="balanced")
    return _cls_eval(E.predict(model, d))


@query("rf_regressor")
def q_rf_regressor(spark, sf):
    d = model_frame(spark, sf, regression=True)
    model = E.rf_regressor(d.where(F.col("split") == "train"), n_estimators=200, max_depth=10,
                           min_samples_leaf=4, max_features="sqrt")
    return _reg_eval(E.predict(model, d))


@query("rf_regression_pipeline")
def q_rf_regression_pipeline(spark, sf):
    """split -> train -> evaluate -> importance -> save; returns importances
    with the test metrics attached."""
    d = model_frame(spark, sf, regression=True)
    model = E.rf_regressor(d.where(F.col("split") == "train"), n_estimators=100, max_depth=10)
    metrics = _reg_eval(E.predict(model, d)).select("rmse", "mae", "r2")
    model.save(scratch_path(spark, "rf_regressor"))
    return E.feature_importance(model, FEATS).crossJoin(metrics)


@query("boosted_classifier")
def q_boosted_classifier(spark, sf):
    from airlag.operators.splits import scale_pos_weight
    d = model_frame(spark, sf, validation=True)
    train = scale_pos_weight(d.where(F.col("split") == "train"), "label")
    model = E.boosted(train, "classification", BOOSTED_CLF, validation_col="is_val")
    return _cls_eval(E.predict(model, d))


@query("boosted_regressor")
def q_boosted_regressor(spark, sf):
    d = model_frame(spark, sf, regression=True, validation=True)
    model = E.boosted(d.where(F.col("split") == "train"), "regression", BOOSTED_REG, validation_col="is_val")
    return _reg_eval(E.predict(model, d))


def _mlp_frame(spark, sf, regression):
    """Split rows, scaled by statistics of the training rows, and those."""
    e = split_random(B.engineered_keyed(spark, sf, regression))
    return standard_scale(e, FEATS, fit_filter=F.col("split") == "train")


@query("mlp_classifier")
def q_mlp_classifier(spark, sf):
    from airlag.operators.splits import class_weight_balanced
    e, _ = _mlp_frame(spark, sf, False)
    e = class_weight_balanced(e, "is_delayed")
    model = train_mlp(e.where(F.col("split") == "train"), FEATS, "is_delayed", "classification",
                      weight_col="weight", max_epochs=100, patience=10)
    pred = model.transform(e).withColumn("label", F.col("is_delayed").cast("double"))
    return _cls_eval(pred)


@query("mlp_regressor")
def q_mlp_regressor(spark, sf):
    e, _ = _mlp_frame(spark, sf, True)
    model = train_mlp(e.where(F.col("split") == "train"), FEATS, "arr_delay_min", "regression",
                      max_epochs=200, patience=10)
    pred = model.transform(e).withColumn("label", F.col("arr_delay_min").cast("double"))
    return _reg_eval(pred)


@query("predict")
def q_predict(spark, sf):
    d = model_frame(spark, sf, scale=True)
    model = E.logistic_regression(d.where(F.col("split") == "train"), class_weight="balanced")
    out = E.predict(model, d.where(F.col("split") == "test"))
    return out.select("row_key", F.col("prediction").cast("int").alias("yhat"), F.col("p1"))


@query("predict_proba")
def q_predict_proba(spark, sf):
    """Both classes' probabilities of the test rows."""
    d = model_frame(spark, sf, scale=True)
    model = E.logistic_regression(d.where(F.col("split") == "train"), class_weight="balanced")
    out = E.predict(model, d.where(F.col("split") == "test"))
    return out.select("row_key", (1 - F.col("p1")).alias("p0"), "p1")


# ----------------------------------------------------------------- §2.11

@query("feature_importance")
def q_feature_importance(spark, sf):
    d = model_frame(spark, sf)
    model = E.rf_classifier(d.where(F.col("split") == "train"), n_estimators=30, max_depth=10,
                            min_samples_leaf=10, class_weight="balanced")
    return E.feature_importance(model, FEATS)


@query("importance_by_type")
def q_importance_by_type(spark, sf):
    d = model_frame(spark, sf, validation=True)
    model = E.boosted(d.where(F.col("split") == "train"), "classification", BOOSTED_CLF,
                      validation_col="is_val")
    return E.importance_by_type(model, FEATS, scratch_path(spark, "gbt"))


@query("coefficients")
def q_coefficients(spark, sf):
    d = model_frame(spark, sf, scale=True)
    model = E.logistic_regression(d.where(F.col("split") == "train"), C=0.1, penalty="l1",
                                  class_weight="balanced")
    return E.coefficients(model, FEATS)


def _folded(spark, sf, k):
    """Training rows with raw features, label and fold."""
    e = split_random(B.engineered_keyed(spark, sf)).where(F.col("split") == "train")
    return kfold_stratified(e.select("row_key", *FEATS, F.col("is_delayed").cast("double").alias("label")), "label", k=k)


@query("grid_search")
def q_grid_search(spark, sf):
    return grid_search_lr(_folded(spark, sf, 5), FEATS, parallelism=8)


@query("random_search")
def q_random_search(spark, sf):
    return random_search_lr(_folded(spark, sf, 3), FEATS, parallelism=8)


@query("grid_search_mlp_classifier")
def q_grid_search_mlp_classifier(spark, sf):
    """The published grid of four networks on three folds, balanced row weights."""
    from airlag.operators.splits import class_weight_balanced
    train = class_weight_balanced(_folded(spark, sf, 3), "label")
    return TU.grid_search_mlp(train, FEATS, "classification", TU.MLP_GRID_CLF, max_epochs=TU.MLP_GRID_EPOCHS,
                              patience=TU.MLP_GRID_PATIENCE["classification"], weight_col="weight")


@query("grid_search_mlp_regressor")
def q_grid_search_mlp_regressor(spark, sf):
    """The published grid of 48 networks on three folds."""
    e = split_random(B.engineered_keyed(spark, sf, True)).where(F.col("split") == "train")
    train = e.select("row_key", *FEATS, F.col("arr_delay_min").cast("double").alias("label"),
                     F.pmod(F.xxhash64(F.lit(42), F.col("row_key")), F.lit(3)).cast("int").alias("fold"))
    return TU.grid_search_mlp(train, FEATS, "regression", TU.MLP_GRID_REG, max_epochs=TU.MLP_GRID_EPOCHS,
                              patience=TU.MLP_GRID_PATIENCE["regression"])


@query("model_info")
def q_model_info(spark, sf):
    d = model_frame(spark, sf, validation=True)
    model = E.boosted(d.where(F.col("split") == "train"), "classification", BOOSTED_CLF,
                      validation_col="is_val")
    return E.model_info(model, "classification", FEATS, "none")


@query("save_model")
def q_save_model(spark, sf):
    """Fit a pipeline, save it with its feature list, load it back and
    predict with the loaded model."""
    from pyspark.ml.classification import LogisticRegression
    e = split_random(B.engineered_keyed(spark, sf)).withColumn("label", F.col("is_delayed").cast("double"))
    pipe = E.fit_pipeline(e.where(F.col("split") == "train"), FEATS,
                          LogisticRegression(maxIter=50, regParam=0.01))
    path = scratch_path(spark, "lr_pipeline")
    E.save_model(pipe, path, FEATS, {"task": "classification", "threshold": 15, "balancing": "none",
                                     "config": {"maxIter": 50, "regParam": 0.01}})
    loaded, meta = E.load_model(path)
    out = E.predict(loaded, e.where(F.col("split") == "test"))
    return out.select("row_key", F.col("prediction").cast("int").alias("yhat"),
                      F.lit(",".join(meta["feature_columns"])).alias("features"))


@query("load_model")
def q_load_model(spark, sf):
    """A saved network scores raw rows as the fitted one scores scaled rows."""
    e, stats = _mlp_frame(spark, sf, False)
    model = train_mlp(e.where(F.col("split") == "train"), FEATS, "is_delayed", "classification", scaler=stats)
    path = scratch_path(spark, "mlp")
    model.save(path)
    loaded = MLPModel.load(path)
    raw = split_random(B.engineered_keyed(spark, sf)).where(F.col("split") == "test")
    a = model.transform(raw).select("row_key", F.col("p1").alias("p_fit"))
    b = loaded.transform(raw).select("row_key", F.col("p1").alias("p_loaded"))
    return a.join(b, "row_key").withColumn("equal", F.abs(F.col("p_fit") - F.col("p_loaded")) < 1e-12)


# ------------------------------------------------------ summaries / reports

def _summary_rows(spark, sf):
    d = model_frame(spark, sf, scale=True)
    rows = None
    for name, cw in [("lr", None), ("lr_balanced", "balanced")]:
        m = _cls_eval(E.predict(E.logistic_regression(d.where(F.col("split") == "train"),
                                                      class_weight=cw), d))
        m = m.select(F.lit(name).alias("model"), "*")
        rows = m if rows is None else rows.unionByName(m)
    return rows


@query("write_summary")
def q_write_summary(spark, sf):
    path = scratch_path(spark, "summary")
    SK.write_summary(_summary_rows(spark, sf), path)
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


@query("append_summary")
def q_append_summary(spark, sf):
    """Two appends: the first creates the summary, the second adds a model with other metrics."""
    path = scratch_path(spark, "summary")
    SK.append_summary(_summary_rows(spark, sf), path)
    d = model_frame(spark, sf, regression=True)
    model = E.rf_regressor(d.where(F.col("split") == "train"), n_estimators=20, max_depth=8)
    SK.append_summary(_reg_eval(E.predict(model, d)).select(F.lit("rf_regressor").alias("model"), "*"), path)
    return SK.read_summary(spark, path)


@query("write_json_report")
def q_write_json_report(spark, sf):
    d = model_frame(spark, sf, validation=True)
    model = E.boosted(d.where(F.col("split") == "train"), "classification", BOOSTED_CLF,
                      validation_col="is_val")
    m = _cls_eval(E.predict(model, d)).first().asDict()
    rep = SK.report_frame(spark, {k: v for k, v in m.items() if k != "split"},
                          dict(BOOSTED_CLF, rounds=model.rounds, best_iteration=model.best_iteration),
                          dt.datetime.now(dt.timezone.utc).isoformat(),
                          "classification")
    path = scratch_path(spark, "report")
    SK.write_json_report(rep, path)
    return spark.read.json(path)


@query("smote_oversample")
def q_smote_oversample(spark, sf):
    """Training rows of the engineered table plus SMOTE rows for the minority
    class, up to the majority size."""
    from airlag.operators.smote import smote_oversample
    e = split_random(B.engineered_keyed(spark, sf)).where(F.col("split") == "train")
    e = e.select("row_key", *FEATS, "is_delayed")
    return smote_oversample(e, "is_delayed", FEATS, "row_key", k=5)
