"""Estimators: logistic regression on Spark ML, random forests of
``plans/forest.py``, boosted trees of ``plans/boosting.py``, plus prediction, importance, coefficients and persistence.

Training frames are assembled once and checkpointed into the session's
checkpoint folder (``cut_lineage``) before fitting: iterative fitters make many
passes, and a lost executor must recompute from the checkpoint, not from the
raw scan, join and de-duplication.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlag.operators.features import numeric_coerce
from airlag.operators.splits import class_weight_balanced, scale_pos_weight
from airlag.plans.boosting import BoostedTrees, fit_boosted
from airlag.plans.forest import Forest, fit_forest
from airlag.session import cut_lineage

SPARK_MAX_DEPTH = 30

# --- fixed values: published default / tuned boosted-tree configurations -----
BOOSTED_DEFAULT_REG = {"n_estimators": 1000, "max_depth": 8, "learning_rate": 0.1,
                       "subsample": 0.8, "colsample_bytree": 0.8, "early_stopping_rounds": 50}
BOOSTED_DEFAULT_CLF = {"n_estimators": 1000, "max_depth": 6, "learning_rate": 0.1,
                       "subsample": 0.8, "colsample_bytree": 0.8, "early_stopping_rounds": 50}
BOOSTED_TUNED_REG = {"n_estimators": 1576, "max_depth": 9, "learning_rate": 0.2342,
                     "subsample": 0.8347, "colsample_bytree": 0.9378, "early_stopping_rounds": 50}
BOOSTED_TUNED_CLF = {"n_estimators": 1516, "max_depth": 6, "learning_rate": 0.2880,
                     "subsample": 0.9378, "colsample_bytree": 0.7581, "early_stopping_rounds": 50}
# ----------------------------------------------------------------------------


def assembler(feature_cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=feature_cols, outputCol=out, handleInvalid="keep")


def prepare(df: DataFrame, feature_cols: list[str], label: str, keep: tuple = (),
            checkpoint: bool = True) -> DataFrame:
    """Numeric-coerced features -> vector ``features`` + double ``label``."""
    df = numeric_coerce(df, feature_cols)
    out = assembler(feature_cols).transform(df).select(
        *keep, "features", F.col(label).cast("double").alias("label"))
    return cut_lineage(out) if checkpoint else out


def load_xy(df: DataFrame, task: str, threshold: float = 15, target: str | None = None) -> tuple[DataFrame, list[str], str]:
    """Features and target by task: (frame, feature columns, target).

    Without ``target``: the arrival delay, else the departure delay, for
    regression; ``is_delayed``, else arrival delay over ``threshold``, for
    classification; no such column is an error.  The date is dropped,
    non-numeric features are coerced (what is no number becomes 0), and for
    classification the arrival delay is no feature (leakage) and exactly two
    classes are required."""
    if target is None:
        wanted = ("arr_delay_min", "dep_delay_min") if task == "regression" else ("is_delayed",)
        target = next((c for c in wanted if c in df.columns), None)
        if target is None and task != "regression" and "arr_delay_min" in df.columns:
            target = "is_delayed"
            df = df.withColumn(target, F.coalesce(F.col("arr_delay_min") > threshold, F.lit(False)).cast("int"))
    if target is None or target not in df.columns:
        raise ValueError(f"no target column for {task}")
    left_out = {target, "flight_date", "row_key"} | ({"arr_delay_min"} if task != "regression" else {"is_delayed"})
    feats = [c for c in df.columns if c not in left_out]
    text = [f.name for f in df.schema.fields if f.name in feats and not isinstance(f.dataType, T.NumericType)]
    if text:
        df = numeric_coerce(df, text)
    if task != "regression":
        n_classes = df.agg(F.count_distinct(target)).first()[0]
        if n_classes != 2:
            raise ValueError(f"classification needs 2 classes, found {n_classes}")
    keep = [c for c in df.columns if c in feats or c == target or c == "row_key"]
    return df.select(*keep), feats, target


# ------------------------------------------------------------------ fitting

def with_weights(df: DataFrame, class_weight: str | None, label: str = "label") -> DataFrame:
    """``weight`` by class; rows that stand for a number of ``copies`` weigh as many."""
    if "copies" in df.columns and class_weight in (None, "balanced"):
        per = F.lit(1.0)
        if class_weight == "balanced":
            n = {r[0]: r[1] for r in df.groupBy(label).agg(F.sum("copies")).collect()}  # a row per class
            for value, m in n.items():
                per = F.when(F.col(label) == value, sum(n.values()) / (len(n) * m)).otherwise(per)
        return df.withColumn("weight", F.col("copies") * per)
    if class_weight == "balanced":
        return class_weight_balanced(df, label, "weight")
    if class_weight == "scale_pos_weight":
        return scale_pos_weight(df, label, "weight")
    return df


def logistic_regression(df: DataFrame, C: float = 1.0, penalty: str = "l2",
                        class_weight: str | None = None, max_iter: int = 100, tol: float = 1e-4):
    """L1/L2 logistic regression with the inverse strength C.

    The penalised objective C * sum(w_i loss_i) + pen(beta) equals Spark's
    mean-loss form with regParam = 1 / (C * sum(w)), on the unstandardised
    (already scaled) vector."""
    df = with_weights(df, class_weight)
    wcol = "weight" if "weight" in df.columns else None
    sum_w = df.agg(F.sum(F.col(wcol)) if wcol else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, tol=tol,
                            regParam=1.0 / (C * float(sum_w)),
                            elasticNetParam=1.0 if penalty == "l1" else 0.0,
                            standardization=False)
    if wcol:
        lr.setWeightCol(wcol)
    return lr.fit(df)


def effective_depth(max_depth: int | None) -> int:
    """Trees go down to depth 30.  No limit (None) means that depth; a
    larger number cannot be honoured and is an error."""
    if max_depth is None:
        return SPARK_MAX_DEPTH
    if int(max_depth) > SPARK_MAX_DEPTH:
        raise ValueError(f"depth {max_depth} asked, {SPARK_MAX_DEPTH} possible")
    return int(max_depth)


def rf_classifier(df: DataFrame, n_estimators: int = 100, max_depth: int | None = None,
                  min_samples_leaf: int = 1, class_weight: str | None = None,
                  max_features: str = "sqrt", seed: int = 42) -> Forest:
    df = with_weights(df, class_weight)
    return fit_forest(df, "classification", n_estimators, effective_depth(max_depth), min_samples_leaf, max_features, seed)


def rf_regressor(df: DataFrame, n_estimators: int = 100, max_depth: int | None = None,
                 min_samples_leaf: int = 1, max_features: str = "all", seed: int = 42) -> Forest:
    return fit_forest(df, "regression", n_estimators, effective_depth(max_depth), min_samples_leaf, max_features, seed)


def boosted(df: DataFrame, task: str, config: dict | None = None, validation_col: str | None = None,
            seed: int = 42) -> BoostedTrees:
    """Gradient-boosted trees (``plans/boosting.py``) with the configured number of rounds.

    With ``validation_col`` (rows it marks are held back) training stops when
    the best round on the held-back rows lies ``early_stopping_rounds`` back, and
    the model is that of the best round.  It has ``best_iteration`` (from 0),
    ``best_score`` (the held-back loss) and ``rounds``."""
    cfg = config or (BOOSTED_DEFAULT_REG if task == "regression" else BOOSTED_DEFAULT_CLF)
    return fit_boosted(df, task, cfg, validation_col, seed)


# --------------------------------------------------------------- inference

def predict(model, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` and, for probabilistic classifiers, ``p1``."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("p1", vector_to_array("probability")[1])
    return out


def feature_importance(model, names: list[str]) -> DataFrame:
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist() if hasattr(model, "featureImportances") \
        else [0.0] * len(names)
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def coefficients(model, names: list[str]) -> DataFrame:
    spark = SparkSession.getActiveSession()
    coef = model.coefficients.toArray().tolist()
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, coef)]
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double") \
        .orderBy(F.desc("abs_coefficient"), "feature")


def importance_by_type(model, names: list[str], path: str, top: int = 15) -> DataFrame:
    """Split count (``weight``), mean gain and mean hessian sum (``cover``) per
    feature, read from the persisted node table; each normalised to sum 1."""
    model.save(path)
    spark = SparkSession.getActiveSession()
    split = spark.read.parquet(f"{path}/nodes").select(F.col("feature").alias("fi"), "gain", "cover").where(F.col("fi") >= 0)
    g = split.groupBy("fi").agg(F.count(F.lit(1)).alias("weight"), F.avg("gain").alias("gain"),
                                F.avg("cover").alias("cover"))
    names_df = spark.createDataFrame(list(enumerate(names)), "fi int, feature string")
    tot = g.agg(F.sum("weight").alias("tw"), F.sum("gain").alias("tg"), F.sum("cover").alias("tc"))
    out = g.join(F.broadcast(names_df), "fi").crossJoin(tot).select(
        "feature", F.col("weight").cast("long").alias("split_count"),
        F.round(F.col("weight") / F.col("tw"), 6).alias("weight_norm"),
        F.round(F.col("gain") / F.col("tg"), 6).alias("gain_norm"),
        F.round(F.col("cover") / F.col("tc"), 6).alias("cover_norm"))
    return out.orderBy(F.desc("split_count"), "feature").limit(top)


# -------------------------------------------------------------- persistence

def fit_pipeline(df: DataFrame, feature_cols: list[str], estimator) -> PipelineModel:
    return Pipeline(stages=[assembler(feature_cols), estimator]).fit(df)


def save_model(model: PipelineModel, path: str, feature_cols: list[str], meta: dict, scaler: dict | None = None) -> str:
    """The fitted pipeline and, beside it, its metadata: feature list, what
    ``meta`` names (task, configuration, balancing, ...), the time, and the
    scaler's statistics if features were scaled before the pipeline."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    side = {"feature_columns": feature_cols, "saved_at": dt.datetime.now(dt.timezone.utc).isoformat(), "scaler": scaler, **meta}
    spark.createDataFrame([(json.dumps(side),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")
    return path


def load_model(path: str):
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return PipelineModel.load(f"{path}/model"), meta


def model_info(model, task: str, feature_cols: list[str], balancing: str) -> DataFrame:
    spark = SparkSession.getActiveSession()
    n_trees = len(model.trees) if hasattr(model, "trees") else None
    row = [("trained", task, len(feature_cols), n_trees, getattr(model, "best_iteration", None),
            getattr(model, "best_score", None), balancing, ",".join(feature_cols))]
    return spark.createDataFrame(
        row, "status string, task string, n_features int, n_trees int, best_iteration int, best_score double, "
             "balancing string, features string")
