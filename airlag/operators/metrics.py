"""Evaluation metrics over prediction frames (y, score / yhat, split).

Every metric is an aggregate (optionally grouped, e.g. by split), so it runs
where the predictions are and only a few numbers reach the driver.  Ranking
metrics use the distributed prefix sum in ``ordering``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlag.operators.ordering import cumulative_sums


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def predict_threshold(score: str, t: float = 0.5, inclusive: bool = False) -> Column:
    s = F.col(score)
    return F.coalesce(s >= t if inclusive else s > t, F.lit(False)).cast("int")


# --------------------------------------------------------------- regression

def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE, R2 = 1 - SSE/SST (per group)."""
    e = F.col(y).cast("double") - F.col(yhat).cast("double")
    g = df.groupBy(*(by or []))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"),
                F.avg(F.abs(e)).alias("_mae"), F.sum(e * e).alias("_sse"),
                (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("_sst"))
    return out.select(*(by or []), "n", r6(F.col("_mse")).alias("mse"),
                      r6(F.sqrt("_mse")).alias("rmse"), r6(F.col("_mae")).alias("mae"),
                      r6(1 - F.col("_sse") / F.col("_sst")).alias("r2"))


def within_tolerance(df: DataFrame, y: str, yhat: str, tolerances=(5, 15),
                     by: list[str] | None = None) -> DataFrame:
    err = F.abs(F.col(y).cast("double") - F.col(yhat).cast("double"))
    return df.groupBy(*(by or [])).agg(
        *[r6(F.avg((err <= t).cast("double")) * 100).alias(f"within_{t}min_pct") for t in tolerances])


def residual_stats(df: DataFrame, y: str, yhat: str) -> DataFrame:
    from airlag.operators.profiling import describe_numeric
    res = df.select((F.col(y).cast("double") - F.col(yhat).cast("double")).alias("residual"))
    return describe_numeric(res, ["residual"])


def train_test_overfit_status(metrics: DataFrame, task: str) -> DataFrame:
    """One row per pair of train/test metrics -> gaps and a status label.

    ``metrics`` has a ``split`` column and accuracy/f1 (classification) or
    rmse/r2 (regression)."""
    tr = metrics.where(F.col("split") == "train")
    te = metrics.where(F.col("split") == "test")
    if task == "classification":
        a, b = "accuracy", "f1"
        good, under = 0.02, -0.05
        j = tr.select(F.col(a).alias("tr_a"), F.col(b).alias("tr_b")).crossJoin(
            te.select(F.col(a).alias("te_a"), F.col(b).alias("te_b")))
        ga, gb = F.col("tr_a") - F.col("te_a"), F.col("tr_b") - F.col("te_b")
        status = (F.when((F.abs(ga) < good) & (F.abs(gb) < good), "good")
                  .when((ga < under) | (gb < under), "underfitting").otherwise("overfitting"))
        return j.select(r6(ga).alias("gap_accuracy"), r6(gb).alias("gap_f1"), status.alias("status"))
    j = tr.select(F.col("rmse").alias("tr_a"), F.col("r2").alias("tr_b")).crossJoin(
        te.select(F.col("rmse").alias("te_a"), F.col("r2").alias("te_b")))
    ga, gb = F.col("tr_a") - F.col("te_a"), F.col("tr_b") - F.col("te_b")
    status = (F.when((F.abs(ga) < 1.0) & (F.abs(gb) < 0.05), "good")
              .when((ga < -2.0) | (gb < -0.1), "underfitting").otherwise("overfitting"))
    return j.select(r6(ga).alias("gap_rmse"), r6(gb).alias("gap_r2"), status.alias("status"))


# ----------------------------------------------------------- classification

def _counts(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    yy, pp = F.col(y), F.col(yhat)
    return df.groupBy(*(by or [])).agg(
        F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
        F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count_if((yy == 0) & (pp == 0)).alias("tn"))


def confusion_matrix(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """Long 2x2: actual, predicted, n (all four cells, zeros included)."""
    c = _counts(df, y, yhat, by)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    structs = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))
               for a, p, n in cells]
    return c.select(*(by or []), F.explode(F.array(*structs)).alias("x")).select(*(by or []), "x.*")


def classification_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, F1 of class 1 (0 when undefined)."""
    c = _counts(df, y, yhat, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    return c.select(*(by or []), r6(_safe_div(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
                    r6(prec).alias("precision"), r6(rec).alias("recall"),
                    r6(_safe_div(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def business_rates(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    c = _counts(df, y, yhat, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*(by or []), r6(_safe_div(tp, tp + fn) * 100).alias("detection_rate_pct"),
                    r6(_safe_div(fp, fp + tn) * 100).alias("false_alarm_rate_pct"))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per class precision/recall/F1/support, then accuracy, macro and
    weighted averages (zero_division = 0)."""
    c = _counts(df, y, yhat)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1, f1_0 = _safe_div(2 * tp, 2 * tp + fp + fn), _safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = [
        ("0", p0, r0, f1_0, s0), ("1", p1, r1, f1_1, s1),
        ("accuracy", F.lit(None), F.lit(None), _safe_div(tp + tn, n), n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        ("weighted avg", _safe_div(p0 * s0 + p1 * s1, n), _safe_div(r0 * s0 + r1 * s1, n),
         _safe_div(f1_0 * s0 + f1_1 * s1, n), n),
    ]
    structs = [F.struct(F.lit(k).alias("class"), r6(p).alias("precision"), r6(r).alias("recall"),
                        r6(f).alias("f1"), s.cast("long").alias("support")) for k, p, r, f, s in rows]
    return c.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


# ------------------------------------------------------------ ranking curves

def _score_counts(df: DataFrame, y: str, score: str, copies: str | None = None) -> DataFrame:
    n = F.col(copies) if copies else F.lit(1)
    return df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.sum(F.col(y).cast("long") * n).alias("pos"), F.sum((1 - F.col(y)).cast("long") * n).alias("neg"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """FPR/TPR at every distinct score used as a '>= threshold' cut."""
    sc = _score_counts(df, y, score)
    cum = cumulative_sums(sc, score, ["pos", "neg"], descending=True)
    return cum.select(
        F.col(score).alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        r6(_safe_div(F.col("cum_pos"), F.col("all_pos"))).alias("tpr"),
        r6(_safe_div(F.col("cum_neg"), F.col("all_neg"))).alias("fpr"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Exact AUC with ties counted half (rank-sum form); null with one class."""
    sc = _score_counts(df, y, score)
    cum = cumulative_sums(sc, score, ["neg"])  # negatives with score <= s
    part = cum.select((F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg")))
                      .alias("u"), "pos", "neg")
    agg = part.agg(F.sum("u").alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(F.col("P").alias("n_pos"), F.col("N").alias("n_neg"),
                      r6(F.when((F.col("P") > 0) & (F.col("N") > 0),
                                F.col("u") / (F.col("P") * F.col("N")))).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, copies: str | None = None) -> DataFrame:
    """Step-wise sum of (R_k - R_{k-1}) * P_k over descending thresholds;
    ``copies``: column with the number of rows that a row stands for."""
    sc = _score_counts(df, y, score, copies)
    cum = cumulative_sums(sc, score, ["pos", "neg"], descending=True)
    term = cum.select(
        (F.col("pos") / F.col("all_pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
        .alias("t"))
    return term.agg(r6(F.sum("t")).alias("average_precision"))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """One row per distinct value: cumulative share of rows <= value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    cum = cumulative_sums(counts, col, ["n"])
    return cum.select(
        col, "n", F.col("cum_n").alias("n_le"), r6(F.col("cum_n") / F.col("all_n")).alias("ecdf"))


# ------------------------------------------------------------ model choice

def model_comparison(base: DataFrame, tuned: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Two one-row metric frames -> metric, baseline, tuned, difference."""
    def long(df, name):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name))
            for m in metric_cols])).alias("x")).select("x.*")
    j = long(base, "baseline").join(long(tuned, "tuned"), "metric")
    return j.withColumn("difference", r6(F.col("tuned") - F.col("baseline")))


def select_best(candidates: DataFrame, metric: str, higher_is_better: bool = True,
                priority_col: str = "priority") -> DataFrame:
    """Best candidate; ties go to the lowest priority value (list order)."""
    order = F.desc(metric) if higher_is_better else F.asc(metric)
    return candidates.orderBy(order, F.asc(priority_col)).limit(1)


def quality_gate(metrics: DataFrame, r2_min: float = 0.7, f1_min: float = 0.8) -> DataFrame:
    cols = set(metrics.columns)
    r2 = F.col("r2") if "r2" in cols else F.lit(None).cast("double")
    f1 = F.col("f1") if "f1" in cols else F.lit(None).cast("double")
    return metrics.withColumn(
        "recommendation",
        F.when((r2 > r2_min) | (f1 > f1_min), "deploy").otherwise("improve"))
