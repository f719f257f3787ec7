"""Profiling reports.

Pattern: fold a whole report into ONE aggregate (partial aggregation on every
partition, one tiny exchange, final merge), then reshape the single wide row
into a long table with ``unpivot``.  Reports never pull data rows to the
driver; only a handful of statistics cross that boundary when a second pass
needs them (IQR bounds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlag import schema as S
from airlag.functions import calendar as C
from airlag.functions.nulls import null_count
from airlag.operators.cleaning import iqr_bounds, numeric_columns, outlier_flag
from airlag.operators.exact_stats import exact_quantiles_many
from airlag.operators.gram import pairwise_pearson

N = "__n"


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _wide_to_long(row: DataFrame, cols: list[str], stats: list[str],
                  key: str = "column") -> DataFrame:
    """Wide one-row frame with ``<stat>__<col>`` fields -> one row per col."""
    structs = [F.struct(F.lit(c).alias(key), *[F.col(f"{s}__{c}").alias(s) for s in stats])
               for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")




# ----------------------------------------------------------- null patterns

WORD_BITS = 62


def null_patterns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(mask, n_rows): one row per distinct pattern of null columns; ``mask``
    is an array of words of 62 columns each, bit i of word j set when
    ``cols[62 * j + i]`` is null.  Every null report derives from this table:
    the input is read once and partial aggregation collapses it to its
    patterns per task."""
    cols = cols or df.columns
    words = [reduce(lambda a, b: a + b,  # disjoint bits: + is OR
                    [F.shiftleft(F.col(f"`{c}`").isNull().cast("long"), i) for i, c in enumerate(cols[lo:lo + WORD_BITS])])
             for lo in range(0, len(cols), WORD_BITS)]
    return df.select(F.array(*words).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n_rows"))


def _bit(i: int) -> Column:
    return F.shiftright(F.col("mask")[i // WORD_BITS], i % WORD_BITS).bitwiseAND(1) == 1


def _n_bits() -> Column:
    return F.aggregate("mask", F.lit(0), lambda n, word: n + F.bit_count(word).cast("int"))

# ------------------------------------------------------------ column level

def column_profile(df: DataFrame) -> DataFrame:
    """column, dtype, non_null, n_null, null_pct (of all rows)."""
    cols = df.columns
    pats = null_patterns(df, cols)
    row = pats.agg(F.sum("n_rows").alias(N),
                   *[F.sum(F.when(_bit(i), F.col("n_rows")).otherwise(0)).alias(f"nul__{c}")
                     for i, c in enumerate(cols)])
    dtypes = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    long = _wide_to_long(row.withColumns({f"n__{c}": F.col(N) for c in cols}), cols, ["nul", "n"])
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(dtypes[c]))])
    return long.select(
        "column", types[F.col("column")].alias("dtype"),
        (F.col("n") - F.col("nul")).cast("long").alias("non_null"),
        F.col("nul").cast("long").alias("n_null"),
        r6(F.col("nul") * 100.0 / F.col("n")).alias("null_pct"))


def dtype_counts(df: DataFrame) -> DataFrame:
    return column_profile(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max;
    the quartiles of all columns come from one counted table."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"),
                 F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"),
                 F.max(x).alias(f"max__{c}")]
    row = df.agg(*aggs)
    quartiles = exact_quantiles_many(df, cols, [0.25, 0.5, 0.75])
    row = row.withColumns({f"q__{c}": F.array(*[F.lit(q).cast("double") for q in quartiles[c]]) for c in cols})
    row = row.withColumns({**{f"p25__{c}": F.col(f"q__{c}")[0] for c in cols},
                           **{f"p50__{c}": F.col(f"q__{c}")[1] for c in cols},
                           **{f"p75__{c}": F.col(f"q__{c}")[2] for c in cols}})
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    long = _wide_to_long(row, cols, stats)
    return long.select("column", "count", *[r6(F.col(s)).alias(s) for s in stats[1:]])


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and % of all rows, largest first."""
    prof = column_profile(df)
    return (prof.where(F.col("n_null") > 0)
            .select("column", F.col("n_null").alias("n_missing"), F.col("null_pct").alias("pct_missing"))
            .orderBy(F.desc("n_missing"), "column"))


def missing_per_row_hist(df: DataFrame) -> DataFrame:
    """Distribution of nulls per row; pct of rows (0 nulls = complete rows)."""
    pats = null_patterns(df)
    counts = pats.groupBy(_n_bits().alias("n_missing")).agg(
        F.sum("n_rows").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("_t"))   # one row
    return counts.crossJoin(total).select(
        "n_missing", F.col("n_rows").cast("long").alias("n_rows"),
        r6(F.col("n_rows") * 100.0 / F.col("_t")).alias("pct_rows"))


def missing_cooccurrence(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows where both columns are null, for every column pair (a before b), > 0."""
    cols = cols or df.columns
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n_both_null long")
    pats = null_patterns(df, cols)
    structs = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                        F.when(_bit(i) & _bit(j), F.col("n_rows")).otherwise(0).alias("n"))
               for i, j in pairs]
    long = pats.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    return (long.groupBy("col_a", "col_b").agg(F.sum("n").cast("long").alias("n_both_null"))
            .where(F.col("n_both_null") > 0))


def outlier_report_iqr(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Per column: IQR bounds, outlier count and % of ALL rows (nulls included)."""
    cols = cols or numeric_columns(df)
    bounds = iqr_bounds(df, cols, k)
    cols = [c for c in cols if c in bounds]
    row = df.agg(F.count(F.lit(1)).alias(N),
                 *[F.count_if(outlier_flag(c, *bounds[c])).alias(f"n__{c}") for c in cols])
    structs = [F.struct(F.lit(c).alias("column"), F.lit(bounds[c][0]).alias("lower_bound"),
                        F.lit(bounds[c][1]).alias("upper_bound"),
                        F.col(f"n__{c}").alias("n_outliers"),
                        (F.col(f"n__{c}") * 100.0 / F.col(N)).alias("pct_outliers")) for c in cols]
    long = row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    return long.select("column", r6(F.col("lower_bound")).alias("lower_bound"),
                       r6(F.col("upper_bound")).alias("upper_bound"), "n_outliers",
                       r6(F.col("pct_outliers")).alias("pct_outliers"))


# ------------------------------------------------------------- correlation

def pearson(a: str, b: str) -> Column:
    """r of the rows that have both; null where a column does not vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)  # corr() fails on a column that does not vary


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r, pairwise-complete, every pair a < b plus the diagonal; null
    where a column does not vary over the pair's rows, NaN where one of them is
    not finite.  See ``operators/gram.py``."""
    return pairwise_pearson(df, cols).select("col_a", "col_b", r6(F.col("r")).alias("r"))


def high_corr_pairs(df: DataFrame, cols: list[str], threshold: float = 0.8) -> DataFrame:
    m = correlation_matrix(df, cols)
    return m.where((F.col("col_a") != F.col("col_b")) & (F.abs("r") > threshold))


def target_correlation(df: DataFrame, target: str, cols: list[str], k: int = 8) -> DataFrame:
    """r of every feature with the target; top k and bottom k (a ranking)."""
    row = df.agg(*[pearson(c, target).alias(f"r__{c}") for c in cols])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"r__{c}").alias("r")) for c in cols]
    long = row.select(F.explode(F.array(*structs)).alias("x")).select(
        "x.feature", r6(F.col("x.r")).alias("r")).where(F.col("r").isNotNull())
    top = long.orderBy(F.desc("r"), "feature").limit(k).withColumn("side", F.lit("top"))
    bottom = long.orderBy(F.asc("r"), "feature").limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def top_corr_submatrix(df: DataFrame, target: str, cols: list[str], k: int = 15) -> DataFrame:
    """With more than k features: the k strongest |r| with the target plus the
    target, as a correlation matrix; otherwise all columns."""
    feats = [c for c in cols if c != target]
    if len(feats) > k:
        row = df.agg(*[F.round(pearson(c, target), 9).alias(c) for c in feats]).first()
        ranked = sorted([c for c in feats if row[c] is not None],
                        key=lambda c: (-abs(row[c]), c))
        feats = ranked[:k]
    return correlation_matrix(df, [target] + feats)


# ------------------------------------------------------------ table quality

def count_duplicates(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates in one grouped pass (copies collapse
    in the partial aggregate before the shuffle)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum("_c").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                 F.sum(F.col("_c") - 1).cast("long").alias("n_duplicates"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row: duplicates, columns with nulls, constant columns (one distinct
    non-null value, i.e. min = max), and column counts by type."""
    cols = df.columns
    row = df.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(f"null__{i}") for i, c in enumerate(cols)],
                 *[(F.min(f"`{c}`") == F.max(f"`{c}`")).alias(f"const__{c}") for c in cols])
    n_null_cols = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"null__{i}"), F.lit(False)).cast("int")
                                              for i in range(len(cols))])
    n_const = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"const__{c}"), F.lit(False)).cast("int")
                                          for c in cols])
    types = [f.dataType for f in df.schema.fields]
    n_num = sum(isinstance(t, (T.NumericType,)) for t in types)
    n_str = sum(isinstance(t, T.StringType) for t in types)
    n_date = sum(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in types)
    q = row.select(n_null_cols.alias("n_cols_with_nulls"), n_const.alias("n_constant_cols"),
                   F.lit(n_num).alias("n_numeric_cols"), F.lit(n_str).alias("n_string_cols"),
                   F.lit(n_date).alias("n_date_cols"))
    return count_duplicates(df).crossJoin(q)  # one row x one row


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """nunique per column (nulls ignored).

    Exact: the (column, value) pairs are de-duplicated in one shuffle, then
    counted per column; no multi-distinct expansion of the input.
    """
    cols = cols or df.columns
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"d__{c}") for c in cols])
        return _wide_to_long(row, cols, ["d"]).select("column", F.col("d").alias("n_distinct"))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")).select("p.*").where(F.col("value").isNotNull())
    return long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Frequency (desc, ties by value) and share of non-null rows."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_t"))
    out = g.crossJoin(total).select(col, "n", r6(F.col("n") * 100.0 / F.col("_t")).alias("pct"))
    out = out.orderBy(F.desc("n"), F.asc(col))
    return out.limit(top) if top else out


# -------------------------------------------------------- delay breakdowns

def delay_buckets3(df: DataFrame, col: str = S.TARGET_DELAY) -> DataFrame:
    d = F.col(col)
    return df.agg(F.count_if(d < 0).alias("n_early"),
                  F.count_if((d >= 0) & (d <= 15)).alias("n_on_time"),
                  F.count_if(d > 15).alias("n_delayed"))


def delay_buckets4(df: DataFrame, col: str = S.TARGET_DELAY) -> DataFrame:
    d = F.col(col)
    row = df.agg(F.count(F.lit(1)).alias(N),
                 F.count_if(d < 0).alias("n__early"),
                 F.count_if((d >= 0) & (d <= 15)).alias("n__on_time"),
                 F.count_if((d > 15) & (d <= 60)).alias("n__minor"),
                 F.count_if(d > 60).alias("n__major"))
    row = row.withColumns({f"t__{b}": F.col(N) for b in ["early", "on_time", "minor", "major"]})
    long = _wide_to_long(row, ["early", "on_time", "minor", "major"], ["n", "t"], key="category")
    return long.select("category", F.col("n").alias("n_flights"),
                       r6(F.col("n") * 100.0 / F.col("t")).alias("pct"))


def sign_counts(df: DataFrame, col: str = S.TARGET_DELAY) -> DataFrame:
    d = F.col(col)
    return df.agg(F.count_if(d < 0).alias("n_negative"), F.count_if(d == 0).alias("n_zero"),
                  F.count_if(d > 0).alias("n_positive"))


def delay_component_totals(df: DataFrame, cols: list[str] = S.DELAY_CAUSE_COLS) -> DataFrame:
    row = df.agg(*[F.sum(F.col(c).cast("long")).alias(f"t__{c}") for c in cols])
    grand = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"t__{c}"), F.lit(0)) for c in cols])
    row = row.withColumns({f"g__{c}": grand for c in cols})
    long = _wide_to_long(row, cols, ["t", "g"], key="component")
    return long.select("component", F.col("t").alias("total_min"),
                       r6(F.col("t") * 100.0 / F.col("g")).alias("pct_of_total"))


def flights_by_month(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    return df.groupBy(C.year_month(date_col).alias("year_month")).agg(
        F.count(F.lit(1)).alias("n_flights"))


def daily_counts_tail(df: DataFrame, n: int = 10, date_col: str = "flight_date") -> DataFrame:
    return (df.where(F.col(date_col).isNotNull()).groupBy(date_col)
            .agg(F.count(F.lit(1)).alias("n_flights")).orderBy(F.desc(date_col)).limit(n))


def monthly_counts_tail(df: DataFrame, n: int = 6, date_col: str = "flight_date") -> DataFrame:
    return (flights_by_month(df.where(F.col(date_col).isNotNull()), date_col)
            .orderBy(F.desc("year_month")).limit(n))


def latest_by_carrier(df: DataFrame, n: int = 10) -> DataFrame:
    return (df.groupBy("carrier_code").agg(F.max("flight_date").alias("latest_date"))
            .orderBy(F.desc("latest_date"), F.desc("carrier_code")).limit(n))


def date_coverage(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    d = F.col(date_col)
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                  F.count_if(d.isNull()).alias("n_unparsable"),
                  F.datediff(F.max(d), F.min(d)).alias("span_days"))


def mean_delay_by(df: DataFrame, key: str, col: str = S.TARGET_DELAY) -> DataFrame:
    return df.groupBy(key).agg(r6(F.avg(col)).alias("mean_delay"),
                               F.count(F.lit(1)).alias("n_flights"))


def flag_shares(df: DataFrame, flags: list[str]) -> DataFrame:
    row = df.agg(*[F.sum(F.col(f).cast("long")).alias(f"s__{f}") for f in flags],
                 *[F.avg(F.col(f).cast("double")).alias(f"m__{f}") for f in flags])
    long = _wide_to_long(row, flags, ["s", "m"], key="flag")
    return long.select("flag", F.col("s").alias("n_set"), r6(F.col("m") * 100).alias("pct_set"))


def class_balance(df: DataFrame, label: str = S.TARGET_CLASS) -> DataFrame:
    """Per class: count, % and the imbalance ratio n0 / n1 (one small frame)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("_t"), F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("_n0"),
                F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("_n1"))
    return g.crossJoin(tot).select(
        F.col(label).alias("label"), "n", r6(F.col("n") * 100.0 / F.col("_t")).alias("pct"),
        r6(F.try_divide(F.col("_n0").cast("double"), F.col("_n1"))).alias("imbalance_ratio"))


def _moments(df: DataFrame, col: str, prefix: str) -> list[Column]:
    x = F.col(col).cast("double")
    return [F.count(x).alias(f"{prefix}count"), F.avg(x).alias(f"{prefix}mean"),
            F.stddev_samp(x).alias(f"{prefix}std"), F.min(x).alias(f"{prefix}min"),
            F.max(x).alias(f"{prefix}max"),
            F.lit(exact_quantiles_many(df, [col], [0.5])[col][0]).cast("double").alias(f"{prefix}median")]


def distribution_compare(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """count/mean/std/min/max/median of two datasets and b - a (two one-row
    aggregates joined)."""
    ra = a.agg(*_moments(a, col, "a_"))
    rb = b.agg(*_moments(b, col, "b_"))
    row = ra.crossJoin(rb)
    stats = ["count", "mean", "std", "min", "max", "median"]
    structs = [F.struct(F.lit(s).alias("stat"), F.col(f"a_{s}").cast("double").alias("a"),
                        F.col(f"b_{s}").cast("double").alias("b")) for s in stats]
    long = row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    return long.select("stat", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"),
                       r6(F.col("b") - F.col("a")).alias("diff"))


def shape_moments(df: DataFrame, col: str) -> DataFrame:
    """Bias-corrected sample skewness G1 and excess kurtosis G2."""
    x = F.col(col).cast("double")
    row = df.agg(F.count(x).alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n").cast("double")
    g1 = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return row.select("n", r6(g1).alias("skewness"), r6(g2).alias("kurtosis"))


# ----------------------------------------------------------------- filters

def extreme_delay_rows(df: DataFrame, threshold: float = 1500,
                       col: str = S.TARGET_DELAY) -> DataFrame:
    return df.filter(F.col(col) > threshold)


def recent_window_rows(df: DataFrame, days: int = 30, date_col: str = "flight_date") -> DataFrame:
    """Rows within ``days`` of the latest date: count, total and share.  The
    latest date is a one-row aggregate joined back (broadcast of one row)."""
    mx = df.agg(F.max(date_col).alias("max_date"), F.count(F.lit(1)).alias("n_total"))
    j = df.select(date_col).crossJoin(F.broadcast(mx))
    return (j.where(F.col(date_col) >= F.date_sub("max_date", days))
            .groupBy("max_date", "n_total").agg(F.count(F.lit(1)).alias("n_recent"))
            .select("n_recent", "n_total", r6(F.col("n_recent") * 100.0 / F.col("n_total"))
                    .alias("pct_recent"), "max_date"))


# ------------------------------------------------------------ stage reports

def preprocessing_summary(raw: DataFrame, clean: DataFrame, date_col: str = "flight_date") -> DataFrame:
    """One row: rows before/after, removed, columns, remaining nulls,
    duplicates left, unknown tails, date range, carriers, airports, delayed
    and on-time counts (two one-row aggregates joined)."""
    r = raw.agg(F.count(F.lit(1)).alias("rows_raw"))
    cols = clean.columns
    c = clean.agg(
        F.count(F.lit(1)).alias("rows_clean"),
        reduce(lambda a, b: a + b, [F.count_if(F.col(x).isNull()) for x in cols]).alias("missing_values"),
        F.count_if(F.col("tail_number") == "Unknown").alias("unknown_tails"),
        F.min(date_col).alias("date_min"), F.max(date_col).alias("date_max"),
        F.count_distinct("carrier_code").alias("n_carriers"),
        F.count_distinct("origin_airport").alias("n_airports"),
        F.count_if(F.col(S.TARGET_DELAY) > 15).alias("n_delayed"),
        F.count_if(F.col(S.TARGET_DELAY) <= 15).alias("n_on_time"))
    d = count_duplicates(clean).select(F.col("n_duplicates").alias("duplicates_left"))
    return (r.crossJoin(c).crossJoin(d)
            .withColumn("rows_removed", F.col("rows_raw") - F.col("rows_clean"))
            .withColumn("n_columns", F.lit(len(cols))))


def cleaning_checks(raw: DataFrame, valid: DataFrame, clean: DataFrame) -> DataFrame:
    """Invalid rows removed, Unknown-tail share, remaining nulls outside the
    time-string columns, duplicates left; ``passed`` when the last two are 0."""
    non_time = [c for c in clean.columns if c not in S.TIME_STRING_COLS]
    r = raw.agg(F.count(F.lit(1)).alias("_raw"))
    v = valid.agg(F.count(F.lit(1)).alias("_valid"))
    c = clean.agg(
        F.count(F.lit(1)).alias("_clean"),
        r6(F.avg((F.col("tail_number") == "Unknown").cast("double")) * 100).alias("unknown_tail_pct"),
        reduce(lambda a, b: a + b, [F.count_if(F.col(x).isNull()) for x in non_time])
        .alias("remaining_nulls"))
    d = count_duplicates(clean).select(F.col("n_duplicates").alias("duplicates_left"))
    out = r.crossJoin(v).crossJoin(c).crossJoin(d)
    return out.select((F.col("_raw") - F.col("_valid")).alias("invalid_removed"),
                      "unknown_tail_pct", "remaining_nulls", "duplicates_left",
                      ((F.col("remaining_nulls") == 0) & (F.col("duplicates_left") == 0)).alias("passed"))
