"""Registered queries: profiling reports and plot data (§2.5, §2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlag import schema as S
from airlag.operators import profiling as P
from airlag.operators import sketches as K
from airlag.plans import base as B
from airlag.plans import sqlbase as Q
from airlag.plans.q_prep import ENGINEERED_CTE
from airlag.plans.registry import query
from airlag.plans.sqlgen import CARRIERS, CLEAN_ORDER, NUMERIC_CLEAN, iqr_cte, r6
from airlag.sources.csv_ingest import scratch_path

W = Q.with_ctes
DATED_TYPES = {
    "carrier_code": "string", "flight_date": "date", "flight_number": "int",
    "tail_number": "string", "origin_airport": "string", "sched_arr_time": "string",
    "actual_arr_time": "string", "wheels_on_time": "string",
    **{c: "smallint" for c in CLEAN_ORDER[8:]},
}
FILTER = "count(*) FILTER (WHERE {})"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------ column level

@query("column_profile", W(Q.DATED) + _union([
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
    f"count(*) - count({c}) AS n_null, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct "
    f"FROM dated" for c, t in DATED_TYPES.items()]))
def q_column_profile(spark, sf):
    return P.column_profile(B.dated(spark, sf))


@query("describe_numeric", W(Q.CLEAN) + _union([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r6(f'avg({c})')} AS mean, "
    f"{r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, "
    f"{r6(f'quantile_cont({c}, 0.25)')} AS p25, {r6(f'quantile_cont({c}, 0.5)')} AS p50, "
    f"{r6(f'quantile_cont({c}, 0.75)')} AS p75, {r6(f'max({c})')} AS max FROM clean"
    for c in NUMERIC_CLEAN]))
def q_describe_numeric(spark, sf):
    return P.describe_numeric(B.clean(spark, sf), NUMERIC_CLEAN)


@query("describe_numeric_sketched")
def q_describe_numeric_sketched(spark, sf):
    """The profile of all months from sketches stored month by month."""
    path = scratch_path(spark, "sketches")
    month = F.date_format("flight_date", "yyyy-MM")
    K.write_sketches(K.monthly_sketches(B.clean(spark, sf), NUMERIC_CLEAN, month), path)
    return K.describe_sketched(K.read_sketches(spark, path))


@query("missing_by_column", W(Q.DATED) + "SELECT * FROM (" + _union([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, "
    f"{r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS pct_missing FROM dated"
    for c in DATED_TYPES]) + ") WHERE n_missing > 0")
def q_missing_by_column(spark, sf):
    return P.missing_by_column(B.dated(spark, sf))


_NN = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in DATED_TYPES)


@query("missing_per_row_hist", W(Q.DATED) + f"""SELECT n_missing, count(*) AS n_rows,
  {r6('count(*) * 100.0 / (SELECT count(*) FROM dated)')} AS pct_rows
  FROM (SELECT {_NN} AS n_missing FROM dated) GROUP BY n_missing""")
def q_missing_per_row_hist(spark, sf):
    return P.missing_per_row_hist(B.dated(spark, sf))


_COLS = list(DATED_TYPES)
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]


@query("missing_cooccurrence", W(Q.DATED) + "SELECT * FROM (" + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {FILTER.format(f'{a} IS NULL AND {b} IS NULL')} "
    f"AS n_both_null FROM dated" for a, b in _PAIRS]) + ") WHERE n_both_null > 0")
def q_missing_cooccurrence(spark, sf):
    return P.missing_cooccurrence(B.dated(spark, sf))


@query("outlier_report_iqr", W(Q.CLEAN + [iqr_cte("clean", NUMERIC_CLEAN)]) + _union([
    f"SELECT '{c}' AS \"column\", {r6(f'lo_{c}')} AS lower_bound, {r6(f'hi_{c}')} AS upper_bound, "
    f"{FILTER.format(f'{c} < lo_{c} OR {c} > hi_{c}')} AS n_outliers, "
    f"{r6(FILTER.format(f'{c} < lo_{c} OR {c} > hi_{c}') + ' * 100.0 / count(*)')} AS pct_outliers "
    f"FROM clean CROSS JOIN _b GROUP BY lo_{c}, hi_{c}" for c in NUMERIC_CLEAN]))
def q_outlier_report_iqr(spark, sf):
    return P.outlier_report_iqr(B.clean(spark, sf), NUMERIC_CLEAN)


# ------------------------------------------------------------- correlation

def _pairs_sql(pairs, table):
    """(col_a, col_b, r): all correlations in one aggregate; null where a column does not vary."""
    corr = [f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END" for a, b in pairs]
    names = lambda i: "[" + ", ".join(f"'{p[i]}'" for p in pairs) + "]"
    return (f"SELECT unnest({names(0)}) AS col_a, unnest({names(1)}) AS col_b, "
            f"unnest([{', '.join(corr)}]) AS r FROM {table}")


_CORR_SQL = ("SELECT col_a, col_b, " + r6("r") + " AS r FROM ("
             + _pairs_sql([(a, b) for i, a in enumerate(NUMERIC_CLEAN) for b in NUMERIC_CLEAN[i:]], "clean") + ")")


@query("correlation_matrix", W(Q.CLEAN) + _CORR_SQL)
def q_correlation_matrix(spark, sf):
    return P.correlation_matrix(B.clean(spark, sf), NUMERIC_CLEAN)


@query("high_corr_pairs", W(Q.CLEAN) + f"SELECT * FROM ({_CORR_SQL}) WHERE col_a <> col_b AND abs(r) > 0.8")
def q_high_corr_pairs(spark, sf):
    return P.high_corr_pairs(B.clean(spark, sf), NUMERIC_CLEAN)


ENG_FEATURES = (["sched_elapsed_min", "is_weekend", "is_holiday_period"]
                + [f"carrier_{v}" for v in CARRIERS] + ["origin_airport_encoded", "season_encoded"])
_TC = _union([f"SELECT '{c}' AS feature, {r6(f'corr({c}, arr_delay_min)')} AS r FROM eng"
              for c in ENG_FEATURES])


@query("target_correlation", W(ENGINEERED_CTE) + f"""SELECT * FROM (
  (SELECT feature, r, 'top' AS side FROM ({_TC}) WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY r DESC, feature LIMIT 8)
  UNION ALL
  (SELECT feature, r, 'bottom' AS side FROM ({_TC}) WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY r ASC, feature LIMIT 8))""")
def q_target_correlation(spark, sf):
    return P.target_correlation(B.engineered(spark, sf), "arr_delay_min", ENG_FEATURES)


_SUB_CANDIDATES = [c for c in NUMERIC_CLEAN if c != "arr_delay_min"] + [
    "month", "day", "day_of_week", "is_weekend", "is_holiday_period",
    *[f"carrier_{v}" for v in CARRIERS], "origin_airport_encoded", "season_encoded"]
_SUB_ALL = ["arr_delay_min", *_SUB_CANDIDATES]
_SUB_SQL = f"""SELECT x.col_a, x.col_b, {r6("x.r")} AS r FROM (
    SELECT CASE WHEN a.k <= b.k THEN p.col_a ELSE p.col_b END AS col_a, CASE WHEN a.k <= b.k THEN p.col_b ELSE p.col_a END AS col_b, p.r
    FROM pairs p JOIN ranked a ON p.col_a = a.col JOIN ranked b ON p.col_b = b.col WHERE a.k <= 15 AND b.k <= 15) x"""


@query("top_corr_submatrix", W([*ENGINEERED_CTE[:-1],
       "pairs AS (" + _pairs_sql([(a, b) for i, a in enumerate(_SUB_ALL) for b in _SUB_ALL[i:]], "enc") + ")",
       """ranked AS (SELECT 'arr_delay_min' AS col, 0 AS k UNION ALL SELECT col_b,
            row_number() OVER (ORDER BY abs(round(r, 9)) DESC, col_b) FROM pairs
          WHERE col_a = 'arr_delay_min' AND col_b <> 'arr_delay_min' AND r IS NOT NULL)"""]) + _SUB_SQL)
def q_top_corr_submatrix(spark, sf):
    from airlag.operators import features as FE
    enc = FE.encode_categoricals(B.featured(spark, sf))
    return P.top_corr_submatrix(enc, "arr_delay_min", _SUB_CANDIDATES, k=15)


# ------------------------------------------------------------ table quality

@query("count_duplicates", W(Q.DATED) + """SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct,
  CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS c FROM dated GROUP BY ALL_COLS)"""
       .replace("ALL_COLS", ", ".join(DATED_TYPES)))
def q_count_duplicates(spark, sf):
    return P.count_duplicates(B.dated(spark, sf))


_NULLCOLS = " + ".join(f"CAST(count(*) > count({c}) AS INTEGER)" for c in DATED_TYPES)
_CONST = " + ".join(f"CAST(coalesce(min({c}) = max({c}), false) AS INTEGER)" for c in DATED_TYPES)


@query("quality_report", W(Q.DATED) + f"""SELECT d.*, q.* FROM
  (SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c - 1) AS BIGINT) AS n_duplicates
   FROM (SELECT count(*) AS c FROM dated GROUP BY {', '.join(DATED_TYPES)})) d,
  (SELECT CAST({_NULLCOLS} AS INTEGER) AS n_cols_with_nulls, CAST({_CONST} AS INTEGER) AS n_constant_cols,
          10 AS n_numeric_cols, 6 AS n_string_cols, 1 AS n_date_cols FROM dated) q""")
def q_quality_report(spark, sf):
    return P.quality_report(B.dated(spark, sf))


@query("distinct_counts", W(Q.DATED) + _union([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM dated" for c in DATED_TYPES]))
def q_distinct_counts(spark, sf):
    return P.distinct_counts(B.dated(spark, sf))


@query("value_counts", W(Q.CLEAN) + f"""SELECT origin_airport, count(*) AS n,
  {r6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct
  FROM clean WHERE origin_airport IS NOT NULL GROUP BY origin_airport
  ORDER BY n DESC, origin_airport LIMIT 10""")
def q_value_counts(spark, sf):
    return P.value_counts(B.clean(spark, sf), "origin_airport", top=10)


# -------------------------------------------------------- delay breakdowns

@query("delay_buckets3", W(Q.CLEAN_REGRESSION) + f"""SELECT
  {FILTER.format('arr_delay_min < 0')} AS n_early,
  {FILTER.format('arr_delay_min >= 0 AND arr_delay_min <= 15')} AS n_on_time,
  {FILTER.format('arr_delay_min > 15')} AS n_delayed FROM clean""")
def q_delay_buckets3(spark, sf):
    return P.delay_buckets3(B.clean_regression(spark, sf))


_B4 = {"early": "arr_delay_min < 0", "on_time": "arr_delay_min >= 0 AND arr_delay_min <= 15",
       "minor": "arr_delay_min > 15 AND arr_delay_min <= 60", "major": "arr_delay_min > 60"}


@query("delay_buckets4", W(Q.CLEAN_REGRESSION) + _union([
    f"SELECT '{k}' AS category, {FILTER.format(v)} AS n_flights, "
    f"{r6(FILTER.format(v) + ' * 100.0 / count(*)')} AS pct FROM clean" for k, v in _B4.items()]))
def q_delay_buckets4(spark, sf):
    return P.delay_buckets4(B.clean_regression(spark, sf))


@query("sign_counts", W(Q.CLEAN_REGRESSION) + f"""SELECT {FILTER.format('arr_delay_min < 0')} AS n_negative,
  {FILTER.format('arr_delay_min = 0')} AS n_zero, {FILTER.format('arr_delay_min > 0')} AS n_positive FROM clean""")
def q_sign_counts(spark, sf):
    return P.sign_counts(B.clean_regression(spark, sf))


_GRAND = " + ".join(f"coalesce(sum({c}), 0)" for c in S.DELAY_CAUSE_COLS)


@query("delay_component_totals", W(Q.CLEAN) + _union([
    f"SELECT '{c}' AS component, CAST(sum({c}) AS BIGINT) AS total_min, "
    f"{r6(f'sum({c}) * 100.0 / ({_GRAND})')} AS pct_of_total FROM clean" for c in S.DELAY_CAUSE_COLS]))
def q_delay_component_totals(spark, sf):
    return P.delay_component_totals(B.clean(spark, sf))


@query("flights_by_month", W(Q.CLEAN) + """SELECT strftime(flight_date, '%Y-%m') AS year_month,
  count(*) AS n_flights FROM clean GROUP BY 1""")
def q_flights_by_month(spark, sf):
    return P.flights_by_month(B.clean(spark, sf))


@query("daily_counts_tail", W(Q.CLEAN) + """SELECT flight_date, count(*) AS n_flights FROM clean
  WHERE flight_date IS NOT NULL GROUP BY flight_date ORDER BY flight_date DESC LIMIT 10""")
def q_daily_counts_tail(spark, sf):
    return P.daily_counts_tail(B.clean(spark, sf))


@query("monthly_counts_tail", W(Q.CLEAN) + """SELECT strftime(flight_date, '%Y-%m') AS year_month,
  count(*) AS n_flights FROM clean WHERE flight_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 6""")
def q_monthly_counts_tail(spark, sf):
    return P.monthly_counts_tail(B.clean(spark, sf))


@query("latest_by_carrier", W(Q.CLEAN) + """SELECT carrier_code, max(flight_date) AS latest_date
  FROM clean GROUP BY carrier_code ORDER BY latest_date DESC, carrier_code DESC LIMIT 10""")
def q_latest_by_carrier(spark, sf):
    return P.latest_by_carrier(B.clean(spark, sf))


@query("date_coverage", W(Q.DATED) + f"""SELECT min(flight_date) AS min_date, max(flight_date) AS max_date,
  {FILTER.format('flight_date IS NULL')} AS n_unparsable,
  CAST(datediff('day', min(flight_date), max(flight_date)) AS INTEGER) AS span_days FROM dated""")
def q_date_coverage(spark, sf):
    return P.date_coverage(B.dated(spark, sf))


for _key in ["is_weekend", "is_holiday_period", "season", "carrier_code"]:
    _name = {"is_weekend": "weekend", "is_holiday_period": "holiday"}.get(_key, _key.split("_")[0])

    def _make(key):
        def fn(spark, sf):
            return P.mean_delay_by(B.featured(spark, sf), key)
        return fn
    query(f"mean_delay_by_{_name}", W(Q.FEATURES) + f"""SELECT {_key}, {r6('avg(arr_delay_min)')} AS mean_delay,
  count(*) AS n_flights FROM feat GROUP BY {_key}""")(_make(_key))


_FLAGS = ["is_weekend", "is_holiday_period", "is_delayed"]


@query("flag_shares", W(Q.FEATURES) + _union([
    f"SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS n_set, {r6(f'avg({f}) * 100')} AS pct_set FROM feat"
    for f in _FLAGS]))
def q_flag_shares(spark, sf):
    return P.flag_shares(B.featured(spark, sf), _FLAGS)


@query("class_balance", W(Q.FEATURES) + f"""SELECT is_delayed AS label, count(*) AS n,
  {r6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct,
  {r6('sum(count(*)) FILTER (WHERE is_delayed = 0) OVER () / sum(count(*)) FILTER (WHERE is_delayed = 1) OVER ()')} AS imbalance_ratio
  FROM feat GROUP BY is_delayed""")
def q_class_balance(spark, sf):
    return P.class_balance(B.featured(spark, sf))


_MOM = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
        "max": "max({c})", "median": "quantile_cont({c}, 0.5)"}
@query("distribution_compare", W(Q.CLEAN + [
    Q.CLEAN_REGRESSION[-2],
    "clean_b AS (SELECT * FROM _clean0 WHERE arr_delay_min BETWEEN -60 AND 300)"]) + _union([
    f"SELECT '{s}' AS stat, {r6('(SELECT ' + e.format(c='arr_delay_min') + ' FROM clean)')} AS a, "
    f"{r6('(SELECT ' + e.format(c='arr_delay_min') + ' FROM clean_b)')} AS b, "
    f"{r6('(SELECT ' + e.format(c='arr_delay_min') + ' FROM clean_b) - (SELECT ' + e.format(c='arr_delay_min') + ' FROM clean)')} AS diff"
    for s, e in _MOM.items()]))
def q_distribution_compare(spark, sf):
    return P.distribution_compare(B.clean(spark, sf), B.clean_regression(spark, sf), "arr_delay_min")


@query("shape_moments", W(Q.CLEAN_REGRESSION) + f"""SELECT count(arr_delay_min) AS n,
  {r6('skewness(arr_delay_min)')} AS skewness, {r6('kurtosis(arr_delay_min)')} AS kurtosis FROM clean""")
def q_shape_moments(spark, sf):
    return P.shape_moments(B.clean_regression(spark, sf), "arr_delay_min")


_DUP = f"(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM clean GROUP BY {', '.join(DATED_TYPES)}))"
_NULLS_ALL = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in DATED_TYPES)


@query("preprocessing_summary", W(Q.CLEAN) + f"""SELECT (SELECT count(*) FROM raw) AS rows_raw, count(*) AS rows_clean,
  CAST({_NULLS_ALL} AS BIGINT) AS missing_values,
  count(*) FILTER (WHERE tail_number = 'Unknown') AS unknown_tails,
  min(flight_date) AS date_min, max(flight_date) AS date_max,
  count(DISTINCT carrier_code) AS n_carriers, count(DISTINCT origin_airport) AS n_airports,
  count(*) FILTER (WHERE arr_delay_min > 15) AS n_delayed, count(*) FILTER (WHERE arr_delay_min <= 15) AS n_on_time,
  {_DUP} AS duplicates_left, (SELECT count(*) FROM raw) - count(*) AS rows_removed, 17 AS n_columns
  FROM clean""")
def q_preprocessing_summary(spark, sf):
    return P.preprocessing_summary(B.raw(spark, sf), B.clean(spark, sf))


_NONTIME = [c for c in DATED_TYPES if c not in ("sched_arr_time", "actual_arr_time", "wheels_on_time")]


@query("cleaning_checks", W(Q.CLEAN) + f"""SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM valid) AS invalid_removed,
  {r6("avg(CAST(tail_number = 'Unknown' AS DOUBLE)) * 100")} AS unknown_tail_pct,
  CAST({" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _NONTIME)} AS BIGINT) AS remaining_nulls,
  {_DUP} AS duplicates_left,
  (CAST({" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _NONTIME)} AS BIGINT) = 0 AND {_DUP} = 0) AS passed
  FROM clean""")
def q_cleaning_checks(spark, sf):
    return P.cleaning_checks(B.raw(spark, sf), B.valid(spark, sf), B.clean(spark, sf))
