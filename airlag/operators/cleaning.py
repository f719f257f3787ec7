"""Cleaning operators: date canonicalisation, invalid rows, ranges,
imputation, duplicates, type validation and IQR outliers.

Statistics that a step needs (medians, modes, quartiles) are computed first
(``exact_stats``) and applied as literals in a projection, so a step itself
costs one scan plus, for de-duplication, one shuffle of hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlag import schema as S
from airlag.functions.nulls import null_count
from airlag.operators.exact_stats import exact_quantiles_many, modes
from airlag.operators.joins import row_count_at_most
from airlag.session import cut_lineage

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
#: Hashes of copied rows that are broadcast at most (16 bytes each).
REPEATED_BROADCAST = 4_000_000
DATE_CANDIDATES = ["flight_date", "date_mdy", "Date (YYYY-MM-DD)", "Date (MM/DD/YYYY)"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def detect_date_column(df: DataFrame) -> str | None:
    """First present candidate name (canonical preferred)."""
    return next((c for c in DATE_CANDIDATES if c in df.columns), None)


def _move_to(df: DataFrame, col: str, pos: int) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    return df.select(*rest[:pos], col, *rest[pos:])


def canonical_date(df: DataFrame, src: str = "date_mdy", dst: str = "flight_date",
                   fmt: str = "M/d/yyyy", overwrite_missing: bool = False) -> DataFrame:
    """Parse the M/D/Y string into a date (bad -> null), drop the string and put
    the date in second position.  Without a source column the existing date is
    kept, unless ``overwrite_missing`` (load-time variant) sets it to null."""
    if src in df.columns:
        df = df.withColumn(dst, F.try_to_date(F.col(src), fmt)).drop(src)
    elif dst not in df.columns or overwrite_missing:
        df = df.withColumn(dst, F.lit(None).cast("date"))
    return _move_to(df, dst, 1)


def critical_columns(df: DataFrame) -> list[str]:
    date_col = detect_date_column(df)
    cols = list(S.CRITICAL_COLS)
    if date_col:
        cols.insert(1, date_col)
    return cols


def remove_invalid_rows(df: DataFrame, limit: int = S.INVALID_NULL_LIMIT) -> DataFrame:
    """Keep rows with fewer than ``limit`` nulls among the critical columns; a
    critical column absent from the frame counts as null in every row."""
    cols = critical_columns(df)
    present = [c for c in cols if c in df.columns]
    absent = len(cols) - len(present)
    return df.filter(null_count(present) + F.lit(absent) < limit)


def filter_date_range(df: DataFrame, start=None, end=None,
                      date_col: str | None = None) -> DataFrame:
    """Inclusive range, each end optional.  On a stored stage, where the date
    is a column of its own, the filter reaches the scan; before that it is
    evaluated on the parsed date."""
    date_col = date_col or detect_date_column(df)
    if date_col is None:
        return df
    d = F.col(date_col)
    if start:
        df = df.filter(d >= F.to_date(F.lit(str(start))))
    if end:
        df = df.filter(d <= F.to_date(F.lit(str(end))))
    return df


def clip_target_range(df: DataFrame, target: str = S.TARGET_DELAY,
                      cap_min: float = -60, cap_max: float = 300) -> DataFrame:
    """Row removal outside [cap_min, cap_max]; null targets are removed."""
    return df.filter(F.col(target).between(cap_min, cap_max))


# ---------------------------------------------------------------- imputation

def missing_value_plan(df: DataFrame, strategy: str = "median", exact: bool = True):
    """{column: fill value} for every numeric and string column with nulls.
    One pass counts nulls (and takes means); medians and modes are computed for
    the columns that hold nulls only."""
    num = numeric_columns(df) if strategy in ("median", "mean") else []
    cat = [c for c in string_columns(df) if not S.has_time_in_original_name(c)]
    if not num and not cat:
        return {}, {}
    stats = [F.count_if(F.col(c).isNull()).alias(f"n__{c}") for c in num + cat]
    if strategy == "mean":
        stats += [F.avg(c).cast("double").alias(f"v__{c}") for c in num]
    elif strategy == "median" and not exact:
        stats += [F.percentile_approx(c, 0.5, 10000).cast("double").alias(f"v__{c}") for c in num]
    row = df.agg(*stats).first().asDict()
    num, cat = [c for c in num if row[f"n__{c}"] > 0], [c for c in cat if row[f"n__{c}"] > 0]
    if strategy == "median" and exact:
        num_fill = {c: q[0] for c, q in exact_quantiles_many(df, num, [0.5]).items()}
    else:
        num_fill = {c: row[f"v__{c}"] for c in num}
    mode = modes(df, [c for c in cat if c != "tail_number"])
    cat_fill = {c: "Unknown" if mode.get(c) is None else mode[c] for c in cat}
    return num_fill, cat_fill


def apply_fills(df: DataFrame, num_fill: dict, cat_fill: dict) -> DataFrame:
    """Numeric fills are applied in double (a median may be fractional)."""
    exprs = []
    for c in df.columns:
        if c in num_fill and num_fill[c] is not None:
            exprs.append(F.coalesce(F.col(c).cast("double"), F.lit(float(num_fill[c]))).alias(c))
        elif c in cat_fill:
            exprs.append(F.coalesce(F.col(c), F.lit(cat_fill[c])).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def impute_numeric(df: DataFrame, strategy: str = "median", exact: bool = True) -> DataFrame:
    """Median (default) or mean for numeric columns holding nulls; any other
    strategy leaves numerics unchanged."""
    num_fill, _ = missing_value_plan(df.select(*numeric_columns(df)), strategy, exact) \
        if numeric_columns(df) else ({}, {})
    return apply_fills(df, num_fill, {})


def impute_categorical(df: DataFrame) -> DataFrame:
    """tail_number -> 'Unknown'; other string columns -> mode (smallest value on
    ties, 'Unknown' if all null); columns named '... Time' are skipped."""
    cols = string_columns(df)
    _, cat_fill = missing_value_plan(df.select(*cols), "none") if cols else ({}, {})
    return apply_fills(df, {}, cat_fill)


def handle_missing(df: DataFrame, strategy: str = "median", exact: bool = True, stored: bool = False) -> DataFrame:
    """Fills of all columns.  The rows are stored first (unless they are), since
    null counts, medians, modes and the result each read them."""
    df = df if stored else cut_lineage(df, "records")
    num_fill, cat_fill = missing_value_plan(df, strategy, exact)
    return apply_fills(df, num_fill, cat_fill)


# ------------------------------------------------------------ dedup / types

def drop_duplicates(df: DataFrame, stored: bool = False) -> DataFrame:
    """Full-row distinct (nulls equal), of rows that are stored first unless they
    are.  Only 64-bit hashes of all rows are shuffled and counted: a row whose
    hash comes once has no copy and stays where it is, the others are compared
    in full.  Partial aggregation collapses copies before either shuffle, so a
    heavily copied row does not skew a task.  Beyond ``REPEATED_BROADCAST``
    repeated hashes all rows are compared in full."""
    df = df if stored else cut_lineage(df, "rows")
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    seen = df.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_m"))
    repeated = cut_lineage(seen.where(F.col("_m") > 1).select("_h"), "repeated")
    if not row_count_at_most(repeated, REPEATED_BROADCAST):
        return df.dropDuplicates()
    hashed, repeated = df.withColumn("_h", h), F.broadcast(repeated)
    copied = hashed.join(repeated, "_h", "left_semi").drop("_h").dropDuplicates()
    return hashed.join(repeated, "_h", "left_anti").drop("_h").unionByName(copied)


def validate_types(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """Coerce every known column to its declared type; bad values -> null."""
    target = {c: (T.IntegerType() if c == "flight_number" else T.ShortType())
              for c in S.INT_COLS}
    date_col = date_col or detect_date_column(df)
    exprs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in target:
            want = target[f.name]
            if f.dataType == want:
                exprs.append(c)
            elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
                exprs.append(F.round(c).try_cast(want).alias(f.name))
            elif isinstance(f.dataType, T.StringType):
                exprs.append(F.round(c.try_cast("double")).try_cast(want).alias(f.name))
            else:
                exprs.append(c.try_cast(want).alias(f.name))
        elif f.name == date_col and not isinstance(f.dataType, T.DateType):
            exprs.append((F.try_to_date(c.cast("string"), "M/d/yyyy")
                          if f.name == "date_mdy" else F.try_to_date(c.cast("string")))
                         .alias(f.name))
        elif f.name in S.CATEGORICAL_COLS + S.TIME_STRING_COLS + ["tail_number"]:
            exprs.append(c.cast("string").alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


# ---------------------------------------------------------------- outliers

def iqr_bounds(df: DataFrame, cols: list[str] | None = None, k: float = 1.5,
               exact: bool = True) -> dict[str, tuple[float, float]]:
    """{column: (Q1 - k*IQR, Q3 + k*IQR)}, linear interpolation quartiles of
    all columns in one job (``exact=False``: one approximate aggregate)."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return {}
    if exact:
        row = exact_quantiles_many(df, cols, [0.25, 0.75])
    else:
        row = df.agg(*[F.percentile_approx(F.col(c), [0.25, 0.75], 10000).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        q = row[c]
        if q is None or q[0] is None:
            continue
        q1, q3 = float(q[0]), float(q[1])
        iqr = q3 - q1
        out[c] = (q1 - k * iqr, q3 + k * iqr)
    return out


def outlier_flag(col: str, lo: float, hi: float) -> Column:
    c = F.col(col)
    return F.coalesce((c < F.lit(lo)) | (c > F.lit(hi)), F.lit(False))


def cap_outliers_iqr(df: DataFrame, cols: list[str] | None = None, k: float = 1.5,
                     exact: bool = True) -> DataFrame:
    """Clip each column to its own bounds (columns independent); capped
    columns are double, nulls stay null."""
    bounds = iqr_bounds(df, cols, k, exact)
    exprs = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            x = F.col(c).cast("double")
            exprs.append(F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi))
                         .otherwise(x).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def remove_outliers_iqr(df: DataFrame, cols: list[str] | None = None, k: float = 1.5,
                        exact: bool = True) -> DataFrame:
    """Drop a row if any column is outside its bounds; all bounds come from
    the input before any row is removed."""
    bounds = iqr_bounds(df, cols, k, exact)
    if not bounds:
        return df
    any_out = reduce(lambda a, b: a | b, [outlier_flag(c, lo, hi) for c, (lo, hi) in bounds.items()])
    return df.filter(~any_out)


def handle_outliers(df: DataFrame, columns: list[str] | None = None, method: str = "cap",
                    threshold: float = 1.5, exact: bool = True) -> DataFrame:
    if method == "keep":
        return df
    if method == "cap":
        return cap_outliers_iqr(df, columns, threshold, exact)
    if method == "remove":
        return remove_outliers_iqr(df, columns, threshold, exact)
    raise ValueError(f"unknown outlier method {method!r}")
