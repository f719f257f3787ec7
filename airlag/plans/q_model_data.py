"""Registered queries: plot data, ordering/sampling, splits and balancing,
scaling and metrics (§2.6-2.8, standard_scale, §2.10)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from airlag.operators import metrics as M
from airlag.operators import ordering as O
from airlag.operators import plotdata as PD
from airlag.operators import profiling as P
from airlag.operators import splits as SP
from airlag.operators.cleaning import iqr_bounds, outlier_flag
from airlag.plans import base as B
from airlag.plans import sqlbase as Q
from airlag.plans.q_prep import ENGINEERED_CTE
from airlag.plans.registry import query
from airlag.plans.scaling import standard_scale
from airlag.plans.sqlgen import CLEAN_ORDER, NUMERIC_CLEAN, iqr_cte, r6

W = Q.with_ctes
FILTER = "count(*) FILTER (WHERE {})"
_KEY = "md5(concat_ws('|', " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in CLEAN_ORDER) + "))"
H = "CAST(('0x' || substr(md5('{seed}|' || row_key), 1, 8)) AS BIGINT)"
H42 = H.format(seed=42)

KEYED = Q.CLEAN + [f"keyed AS (SELECT *, {_KEY} AS row_key FROM clean)"]
_feat = Q.FEATURES[-1].replace("FROM clean)", "FROM keyed)")
ENG_KEYED = KEYED + [_feat] + ENGINEERED_CTE[len(Q.FEATURES):-1] + [
    ENGINEERED_CTE[-1].replace("eng AS (SELECT ", "eng AS (SELECT row_key, ")]
_X = ("((sched_elapsed_min - 180) + 40 * is_weekend + 25 * is_holiday_period - 15 * season_encoded"
      " + 7 * origin_airport_encoded + 20 * carrier_UR - 10 * carrier_LO)")
SCORED = ENG_KEYED + [f"""scored AS (
  SELECT row_key, CASE WHEN {H42} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split,
         is_delayed AS y, 0.5 + 0.5 * CAST({_X} AS DOUBLE) / CAST(100 + abs({_X}) AS DOUBLE) AS score,
         CAST(0.5 + 0.5 * CAST({_X} AS DOUBLE) / CAST(100 + abs({_X}) AS DOUBLE) > 0.5 AS INTEGER) AS yhat,
         arr_delay_min AS y_reg, {_X} / 4.0 AS yhat_reg
  FROM eng)"""]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ----------------------------------------------------------------- §2.6

_HIST = """, _mm AS (SELECT min(CAST(arr_delay_min AS DOUBLE)) AS lo, max(CAST(arr_delay_min AS DOUBLE)) AS hi FROM clean),
_w AS (SELECT lo, hi, (hi - lo) / 50 AS w FROM _mm),
_c AS (SELECT CAST(least(floor((CAST(arr_delay_min AS DOUBLE) - lo) / w), 49) AS INTEGER) AS bin, count(*) AS n
       FROM clean, _w WHERE arr_delay_min BETWEEN lo AND hi GROUP BY 1)
SELECT g.bin, round(lo + g.bin * w, 6) AS bin_lo, round(lo + (g.bin + 1) * w, 6) AS bin_hi, coalesce(n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) g CROSS JOIN _w LEFT JOIN _c USING (bin)"""


@query("histogram", W(Q.CLEAN).rstrip() + _HIST)
def q_histogram(spark, sf):
    return PD.histogram(B.clean(spark, sf), "arr_delay_min", bins=50)


@query("grouped_histogram", W(SCORED) + """, _c AS (
  SELECT y, CAST(least(floor((score - 0.0) / 0.05), 19) AS INTEGER) AS bin, count(*) AS n
  FROM scored WHERE score BETWEEN 0.0 AND 1.0 GROUP BY 1, 2)
SELECT g.y, g.bin, round(0.0 + g.bin * 0.05, 6) AS bin_lo, round(0.0 + (g.bin + 1) * 0.05, 6) AS bin_hi,
  coalesce(n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin, y FROM range(20), (SELECT DISTINCT y FROM scored)) g
LEFT JOIN _c USING (y, bin)""")
def q_grouped_histogram(spark, sf):
    return PD.histogram(B.scored(spark, sf), "score", bins=20, lo=0.0, hi=1.0, by="y")


@query("ecdf", W(Q.CLEAN_REGRESSION) + f"""SELECT arr_delay_min, n, CAST(n_le AS BIGINT) AS n_le,
  {r6('n_le / sum(n) OVER ()')} AS ecdf FROM (
  SELECT arr_delay_min, n, sum(n) OVER (ORDER BY arr_delay_min) AS n_le FROM (
    SELECT arr_delay_min, count(*) AS n FROM clean WHERE arr_delay_min IS NOT NULL GROUP BY 1))""")
def q_ecdf(spark, sf):
    return M.ecdf(B.clean_regression(spark, sf), "arr_delay_min")


@query("box_stats", W(Q.CLEAN_REGRESSION) + f"""SELECT {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3,
  {r6('(SELECT min(arr_delay_min) FROM clean WHERE arr_delay_min >= q1 - 1.5 * (q3 - q1))')} AS whisker_lo,
  {r6('(SELECT max(arr_delay_min) FROM clean WHERE arr_delay_min <= q3 + 1.5 * (q3 - q1))')} AS whisker_hi,
  (SELECT count(*) FROM clean WHERE arr_delay_min < q1 - 1.5 * (q3 - q1) OR arr_delay_min > q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM (SELECT quantile_cont(arr_delay_min, 0.25) AS q1, quantile_cont(arr_delay_min, 0.5) AS med,
               quantile_cont(arr_delay_min, 0.75) AS q3 FROM clean)""")
def q_box_stats(spark, sf):
    return PD.box_stats(B.clean_regression(spark, sf), "arr_delay_min")


_QQ_PROBS = [(i + 0.5) / 100 for i in range(100)]
_QQ_SQL = ("SELECT p, " + r6("theoretical") + " AS theoretical, " + r6("q") + " AS sample, " + r6("(q - mu) / sd")
           + " AS sample_z FROM (SELECT unnest([" + ", ".join(f"{p}::DOUBLE" for p in _QQ_PROBS)
           + "]) AS p, unnest([" + ", ".join(f"{NormalDist().inv_cdf(p)!r}::DOUBLE" for p in _QQ_PROBS)
           + "]) AS theoretical, unnest(quantile_cont(arr_delay_min::DOUBLE, [" + ", ".join(map(str, _QQ_PROBS))
           + "])) AS q, avg(arr_delay_min) AS mu, stddev_samp(arr_delay_min) AS sd FROM clean)")


@query("qq_points", W(Q.CLEAN_REGRESSION) + _QQ_SQL)
def q_qq_points(spark, sf):
    return PD.qq_points(B.clean_regression(spark, sf), "arr_delay_min")


@query("scatter_sample", W(Q.CLEAN) + """, _m AS (SELECT min(CAST(sched_elapsed_min AS DOUBLE)) AS x0, max(CAST(sched_elapsed_min AS DOUBLE)) AS x1,
  min(CAST(actual_elapsed_min AS DOUBLE)) AS y0, max(CAST(actual_elapsed_min AS DOUBLE)) AS y1 FROM clean)
SELECT CAST(least(floor((sched_elapsed_min - x0) / ((x1 - x0) / 50)), 49) AS INTEGER) AS x_bin,
       CAST(least(floor((actual_elapsed_min - y0) / ((y1 - y0) / 50)), 49) AS INTEGER) AS y_bin,
       count(*) AS n
FROM clean, _m WHERE sched_elapsed_min IS NOT NULL AND actual_elapsed_min IS NOT NULL GROUP BY 1, 2""")
def q_scatter_sample(spark, sf):
    return PD.scatter_bins(B.clean(spark, sf), "sched_elapsed_min", "actual_elapsed_min", bins=50)


@query("scatter_sample_rows", W(KEYED) + f"""SELECT row_key, sched_elapsed_min, actual_elapsed_min FROM keyed
  WHERE {H.format(seed=7)} % 10000 < 100""")
def q_scatter_sample_rows(spark, sf):
    return PD.scatter_sample(B.keyed_clean(spark, sf), "row_key", 0.01).select(
        "row_key", "sched_elapsed_min", "actual_elapsed_min")


_DESC = ("count(r) AS count, {m} AS mean, {s} AS std, {mi} AS min, {p25} AS p25, {p50} AS p50, "
         "{p75} AS p75, {ma} AS max").format(
    m=r6("avg(r)"), s=r6("stddev_samp(r)"), mi=r6("min(r)"), p25=r6("quantile_cont(r, 0.25)"),
    p50=r6("quantile_cont(r, 0.5)"), p75=r6("quantile_cont(r, 0.75)"), ma=r6("max(r)"))


@query("residual_stats", W(SCORED) + f"""SELECT 'residual' AS "column", {_DESC}
  FROM (SELECT CAST(y_reg AS DOUBLE) - yhat_reg AS r FROM scored)""")
def q_residual_stats(spark, sf):
    return M.residual_stats(B.scored(spark, sf), "y_reg", "yhat_reg")


# ----------------------------------------------------------------- §2.7

@query("topk", W(Q.FEATURES) + f"""SELECT origin_airport, carrier_code, {r6('avg(arr_delay_min)')} AS mean_delay,
  count(*) AS n_flights FROM feat GROUP BY 1, 2 ORDER BY mean_delay DESC, origin_airport, carrier_code LIMIT 10""")
def q_topk(spark, sf):
    g = P.mean_delay_by(B.featured(spark, sf).withColumn(
        "k", F.struct("origin_airport", "carrier_code")), "k").select(
        "k.origin_airport", "k.carrier_code", "mean_delay", "n_flights")
    return O.topk(g, [F.desc("mean_delay"), "origin_airport", "carrier_code"], 10)


@query("head_tail_sample", W(KEYED) + f"""SELECT * FROM (
  (SELECT row_key, flight_date, arr_delay_min, 'head' AS part FROM keyed ORDER BY flight_date ASC, row_key ASC LIMIT 10)
  UNION ALL
  (SELECT row_key, flight_date, arr_delay_min, 'tail' AS part FROM keyed ORDER BY flight_date DESC, row_key DESC LIMIT 10)
  UNION ALL
  (SELECT row_key, flight_date, arr_delay_min, 'sample' AS part FROM keyed ORDER BY {H42}, row_key LIMIT 10))""")
def q_head_tail_sample(spark, sf):
    return O.head_tail_sample(B.keyed_clean(spark, sf).select("row_key", "flight_date", "arr_delay_min"),
                              10, ["flight_date"], "row_key")


@query("subsample_n", W(KEYED) + f"SELECT * FROM keyed ORDER BY {H42}, row_key LIMIT 5000")
def q_subsample_n(spark, sf):
    return O.subsample_n(B.keyed_clean(spark, sf), 5000, "row_key")


@query("subsample_n_exact_rank", W(KEYED) + f"SELECT * FROM keyed ORDER BY {H42}, row_key LIMIT 20000")
def q_subsample_n_exact_rank(spark, sf):
    from airlag.operators.ranking import hash_rank
    return hash_rank(B.keyed_clean(spark, sf), [], "row_key", buckets_per_partition=64, first=20000).drop("_rank")


@query("union_all", W(Q.DATED) + "SELECT * FROM dated")
def q_union_all(spark, sf):
    d = B.dated(spark, sf)
    early = d.where(F.col("flight_date") < F.lit("1996-01-01").cast("date"))
    rest = d.where(~(F.col("flight_date") < F.lit("1996-01-01").cast("date"))
                   | F.col("flight_date").isNull())
    return O.union_all(early, rest)


@query("mask_union", W(Q.CLEAN + [iqr_cte("clean", NUMERIC_CLEAN)]) + "SELECT clean.* FROM clean CROSS JOIN _b WHERE "
       + " OR ".join(f"coalesce({c} < lo_{c} OR {c} > hi_{c}, false)" for c in NUMERIC_CLEAN))
def q_mask_union(spark, sf):
    from functools import reduce
    c = B.clean(spark, sf)
    bounds = iqr_bounds(c, NUMERIC_CLEAN)
    return c.where(reduce(lambda a, b: a | b, [outlier_flag(k, *v) for k, v in bounds.items()]))


_NEW = {"month": "int", "day": "int", "day_of_week": "int", "is_weekend": "int", "is_holiday_period": "int",
        "season": "string", "is_delayed": "int"}


@query("new_columns", W(Q.FEATURES) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS n_null, "
    + r6(f"(count(*) - count({c})) * 100.0 / count(*)") + " AS null_pct FROM feat" for c, t in _NEW.items()))
def q_new_columns(spark, sf):
    before, after = B.clean(spark, sf), B.featured(spark, sf)
    added = O.new_columns(before, after)
    return P.column_profile(after.select(*added))


# ----------------------------------------------------------------- §2.8

@query("split_random", W(SCORED) + "SELECT row_key, split FROM scored")
def q_split_random(spark, sf):
    return B.scored(spark, sf).select("row_key", "split")


_RN = f"row_number() OVER (PARTITION BY is_delayed ORDER BY {H42}, row_key)"


@query("split_stratified", W(ENG_KEYED) + f"""SELECT row_key, is_delayed,
  CASE WHEN {_RN} <= round(count(*) OVER (PARTITION BY is_delayed) * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM eng""")
def q_split_stratified(spark, sf):
    e = B.engineered_keyed(spark, sf).select("row_key", "is_delayed")
    return SP.split_stratified(e, "is_delayed")


@query("kfold_stratified", W(ENG_KEYED) + f"SELECT row_key, is_delayed, CAST(({_RN} - 1) % 3 AS INTEGER) AS fold FROM eng")
def q_kfold_stratified(spark, sf):
    e = B.engineered_keyed(spark, sf).select("row_key", "is_delayed")
    return SP.kfold_stratified(e, "is_delayed", k=3)


@query("class_weight_balanced", W(ENG_KEYED) + f"""SELECT row_key, is_delayed,
  {r6('count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY is_delayed))')} AS weight FROM eng""")
def q_class_weight_balanced(spark, sf):
    e = B.engineered_keyed(spark, sf).select("row_key", "is_delayed")
    return SP.class_weight_balanced(e, "is_delayed").withColumn("weight", M.r6(F.col("weight")))


_SPW = f"""SELECT row_key, is_delayed, {r6("CASE WHEN is_delayed = 1 THEN (SELECT count(*) FILTER (WHERE is_delayed = 0) * 1.0 / count(*) FILTER (WHERE is_delayed = 1) FROM eng) ELSE 1.0 END")} AS weight FROM eng"""


@query("scale_pos_weight", W(ENG_KEYED) + _SPW)
def q_scale_pos_weight(spark, sf):
    e = B.engineered_keyed(spark, sf).select("row_key", "is_delayed")
    return SP.scale_pos_weight(e, "is_delayed").withColumn("weight", M.r6(F.col("weight")))


@query("apply_balancing", W(ENG_KEYED) + _SPW)
def q_apply_balancing(spark, sf):
    e = B.engineered_keyed(spark, sf).select("row_key", "is_delayed")
    return SP.apply_balancing(e, "class_weight", "is_delayed").withColumn("weight", M.r6(F.col("weight")))


@query("undersample_majority", W(ENG_KEYED) + f"""SELECT row_key, is_delayed FROM (
  SELECT row_key, is_delayed, {_RN} AS rn FROM eng)
  WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM eng GROUP BY is_delayed))""")
def q_undersample_majority(spark, sf):
    e = B.engineered_keyed(spark, sf).select("row_key", "is_delayed")
    return SP.undersample_majority(e, "is_delayed")


# ------------------------------------------------------------ standard scale

_SC = ["sched_elapsed_min", "origin_airport_encoded", "season_encoded", "is_weekend"]
_SCALE_SQL = W(ENG_KEYED + [f"""sp AS (SELECT *, CASE WHEN {H42} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM eng)""",
                            "st AS (SELECT " + ", ".join(
                                f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                                for c in _SC) + " FROM sp WHERE split = 'train')"]) + \
    "SELECT row_key, split, " + ", ".join(f"{r6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in _SC) + " FROM sp CROSS JOIN st"


@query("standard_scale", _SCALE_SQL)
def q_standard_scale(spark, sf):
    e = SP.split_random(B.engineered_keyed(spark, sf))
    out, _ = standard_scale(e, _SC, fit_filter=F.col("split") == "train")
    return out.select("row_key", "split", *[M.r6(F.col(c)).alias(c) for c in _SC])


# ----------------------------------------------------------------- §2.10

_REG = f"""SELECT split, count(*) AS n, {r6('avg((y_reg - yhat_reg) * (y_reg - yhat_reg))')} AS mse,
  {r6('sqrt(avg((y_reg - yhat_reg) * (y_reg - yhat_reg)))')} AS rmse, {r6('avg(abs(y_reg - yhat_reg))')} AS mae,
  {r6('1 - sum((y_reg - yhat_reg) * (y_reg - yhat_reg)) / (var_pop(y_reg) * count(*))')} AS r2
  FROM scored GROUP BY split"""


@query("regression_metrics", W(SCORED) + _REG)
def q_regression_metrics(spark, sf):
    return M.regression_metrics(B.scored(spark, sf), "y_reg", "yhat_reg", by=["split"])


@query("within_tolerance", W(SCORED) + f"""SELECT split, {r6('avg(CAST(abs(y_reg - yhat_reg) <= 5 AS DOUBLE)) * 100')} AS within_5min_pct,
  {r6('avg(CAST(abs(y_reg - yhat_reg) <= 15 AS DOUBLE)) * 100')} AS within_15min_pct FROM scored GROUP BY split""")
def q_within_tolerance(spark, sf):
    return M.within_tolerance(B.scored(spark, sf), "y_reg", "yhat_reg", by=["split"])


_CNT = ", ".join([f"{FILTER.format('y = 1 AND yhat = 1')} AS tp", f"{FILTER.format('y = 0 AND yhat = 1')} AS fp",
                  f"{FILTER.format('y = 1 AND yhat = 0')} AS fn", f"{FILTER.format('y = 0 AND yhat = 0')} AS tn"])


@query("confusion_matrix", W(SCORED) + f"""SELECT split, a AS actual, p AS predicted, n FROM (
  SELECT split, {_CNT} FROM scored GROUP BY split)
  CROSS JOIN LATERAL (VALUES (0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)) v(a, p, n)""")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(B.scored(spark, sf), "y", "yhat", by=["split"])


def _sd(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


_CLS = f"""SELECT split, {r6(_sd('tp + tn', 'tp + fp + fn + tn'))} AS accuracy, {r6(_sd('tp', 'tp + fp'))} AS precision,
  {r6(_sd('tp', 'tp + fn'))} AS recall, {r6(_sd('2 * tp', '2 * tp + fp + fn'))} AS f1
  FROM (SELECT split, {_CNT} FROM scored GROUP BY split)"""


@query("classification_metrics", W(SCORED) + _CLS)
def q_classification_metrics(spark, sf):
    return M.classification_metrics(B.scored(spark, sf), "y", "yhat", by=["split"])


@query("business_rates", W(SCORED) + f"""SELECT split, {r6(_sd('tp', 'tp + fn') + ' * 100')} AS detection_rate_pct,
  {r6(_sd('fp', 'fp + tn') + ' * 100')} AS false_alarm_rate_pct FROM (SELECT split, {_CNT} FROM scored GROUP BY split)""")
def q_business_rates(spark, sf):
    return M.business_rates(B.scored(spark, sf), "y", "yhat", by=["split"])


@query("classification_report", W(SCORED) + f"""SELECT * FROM (SELECT {_CNT} FROM scored WHERE split = 'test') c,
  LATERAL (SELECT {_sd('tn', 'tn + fn')} AS p0, {_sd('tn', 'tn + fp')} AS r0, {_sd('2 * tn', '2 * tn + fn + fp')} AS f0,
                  {_sd('tp', 'tp + fp')} AS p1, {_sd('tp', 'tp + fn')} AS r1, {_sd('2 * tp', '2 * tp + fp + fn')} AS f1_,
                  tn + fp AS s0, tp + fn AS s1) m,
  LATERAL (VALUES ('0', {r6('p0')}, {r6('r0')}, {r6('f0')}, CAST(s0 AS BIGINT)),
                  ('1', {r6('p1')}, {r6('r1')}, {r6('f1_')}, CAST(s1 AS BIGINT)),
                  ('accuracy', NULL, NULL, {r6(_sd('tp + tn', 's0 + s1'))}, CAST(s0 + s1 AS BIGINT)),
                  ('macro avg', {r6('(p0 + p1) / 2')}, {r6('(r0 + r1) / 2')}, {r6('(f0 + f1_) / 2')}, CAST(s0 + s1 AS BIGINT)),
                  ('weighted avg', {r6(_sd('p0 * s0 + p1 * s1', 's0 + s1'))}, {r6(_sd('r0 * s0 + r1 * s1', 's0 + s1'))},
                   {r6(_sd('f0 * s0 + f1_ * s1', 's0 + s1'))}, CAST(s0 + s1 AS BIGINT))) v("class", precision, recall, f1, support)"""
       .replace("SELECT * FROM", "SELECT v.* FROM", 1))
def q_classification_report(spark, sf):
    return M.classification_report(B.scored(spark, sf).where(F.col("split") == "test"), "y", "yhat")


_SCN = "SELECT score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM scored WHERE split = 'test' GROUP BY score"


@query("roc_auc", W(SCORED) + f"""SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  {r6('CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cn - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) END')} AS roc_auc
  FROM (SELECT *, sum(neg) OVER (ORDER BY score) AS cn FROM ({_SCN}))""")
def q_roc_auc(spark, sf):
    return M.roc_auc(B.scored(spark, sf).where(F.col("split") == "test"), "y", "score")


@query("roc_curve", W(SCORED) + f"""SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  {r6('coalesce(tp / nullif(sum(pos) OVER (), 0), 0.0)')} AS tpr, {r6('coalesce(fp / nullif(sum(neg) OVER (), 0), 0.0)')} AS fpr
  FROM (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM ({_SCN}))""")
def q_roc_curve(spark, sf):
    return M.roc_curve(B.scored(spark, sf).where(F.col("split") == "test"), "y", "score")


@query("average_precision", W(SCORED) + f"""SELECT {r6('sum(pos / sum_p * tp / (tp + fp))')} AS average_precision FROM (
  SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
         sum(pos) OVER () AS sum_p FROM ({_SCN}))""")
def q_average_precision(spark, sf):
    return M.average_precision(B.scored(spark, sf).where(F.col("split") == "test"), "y", "score")


@query("predict_threshold", W(SCORED) + """SELECT row_key, CAST(coalesce(score > 0.55, false) AS INTEGER) AS yhat_gt,
  CAST(coalesce(score >= 0.55, false) AS INTEGER) AS yhat_ge FROM scored""")
def q_predict_threshold(spark, sf):
    return B.scored(spark, sf).select("row_key", M.predict_threshold("score", 0.55).alias("yhat_gt"),
                                      M.predict_threshold("score", 0.55, inclusive=True).alias("yhat_ge"))


def _cls_pair(spark, sf):
    s = B.scored(spark, sf).where(F.col("split") == "test")
    base = M.classification_metrics(s, "y", "yhat")
    tuned = M.classification_metrics(s.withColumn("yhat", M.predict_threshold("score", 0.45)), "y", "yhat")
    return base, tuned


_CLS_T = f"""SELECT {r6(_sd('tp + tn', 'tp + fp + fn + tn'))} AS accuracy, {r6(_sd('tp', 'tp + fp'))} AS precision,
  {r6(_sd('tp', 'tp + fn'))} AS recall, {r6(_sd('2 * tp', '2 * tp + fp + fn'))} AS f1 FROM (SELECT {_CNT} FROM ({{src}}))"""
_BASE = _CLS_T.format(src="SELECT y, yhat FROM scored WHERE split = 'test'")
_TUNED = _CLS_T.format(src="SELECT y, CAST(coalesce(score > 0.45, false) AS INTEGER) AS yhat FROM scored WHERE split = 'test'")


@query("model_comparison", W(SCORED) + f"""SELECT b.metric, b.v AS baseline, t.v AS tuned, {r6('t.v - b.v')} AS difference FROM
  (UNPIVOT ({_BASE}) ON accuracy, precision, recall, f1 INTO NAME metric VALUE v) b
  JOIN (UNPIVOT ({_TUNED}) ON accuracy, precision, recall, f1 INTO NAME metric VALUE v) t USING (metric)""")
def q_model_comparison(spark, sf):
    base, tuned = _cls_pair(spark, sf)
    return M.model_comparison(base, tuned, ["accuracy", "precision", "recall", "f1"])


@query("select_best", W(SCORED) + f"""SELECT * FROM (
  SELECT 'tuned' AS model, 0 AS priority, * FROM ({_TUNED})
  UNION ALL SELECT 'original' AS model, 1 AS priority, * FROM ({_BASE}))
  ORDER BY f1 DESC, priority LIMIT 1""")
def q_select_best(spark, sf):
    base, tuned = _cls_pair(spark, sf)
    cands = (tuned.select(F.lit("tuned").alias("model"), F.lit(0).alias("priority"), "*")
             .unionByName(base.select(F.lit("original").alias("model"), F.lit(1).alias("priority"), "*")))
    return M.select_best(cands, "f1")


@query("quality_gate", W(SCORED) + f"""SELECT *, CASE WHEN f1 > 0.8 THEN 'deploy' ELSE 'improve' END AS recommendation
  FROM ({_BASE})""")
def q_quality_gate(spark, sf):
    base, _ = _cls_pair(spark, sf)
    return M.quality_gate(base)


@query("train_test_overfit_status", W(SCORED) + f"""SELECT {r6('tr.accuracy - te.accuracy')} AS gap_accuracy, {r6('tr.f1 - te.f1')} AS gap_f1,
  CASE WHEN abs(tr.accuracy - te.accuracy) < 0.02 AND abs(tr.f1 - te.f1) < 0.02 THEN 'good'
       WHEN tr.accuracy - te.accuracy < -0.05 OR tr.f1 - te.f1 < -0.05 THEN 'underfitting' ELSE 'overfitting' END AS status
  FROM ({_CLS.replace('GROUP BY split)', "GROUP BY split) WHERE split = 'train'")}) tr,
       ({_CLS.replace('GROUP BY split)', "GROUP BY split) WHERE split = 'test'")}) te""")
def q_train_test_overfit_status(spark, sf):
    m = M.classification_metrics(B.scored(spark, sf), "y", "yhat", by=["split"])
    return M.train_test_overfit_status(m, "classification")
