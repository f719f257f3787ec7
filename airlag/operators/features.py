"""Feature derivation and categorical encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlag import schema as S
from airlag.functions import calendar as C
from airlag.functions.targets import DELAY_THRESHOLD_MIN, is_delayed
from airlag.session import cut_lineage

# --- fixed values: columns of the operational group --------------------------
OPERATIONAL = ["sched_elapsed_min", "actual_elapsed_min", "taxi_in_min"]
# ----------------------------------------------------------------------------


def calendar_parts(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({"month": F.month(d), "day": F.dayofmonth(d),
                           "day_of_week": F.weekday(d)})


def basic_features(df: DataFrame, date_col: str = "flight_date",
                   delay_col: str = S.TARGET_DELAY,
                   threshold: float = DELAY_THRESHOLD_MIN) -> DataFrame:
    """Month, day, day of week, weekend and holiday flags, season and the
    binary target, in a single projection."""
    if date_col not in df.columns:
        raise KeyError(f"expected date column {date_col!r}")
    d = F.col(date_col)
    return df.withColumns({
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "is_weekend": C.is_weekend(d),
        "is_holiday_period": C.is_holiday_period(d),
        "season": C.season(d),
        "is_delayed": is_delayed(delay_col, threshold),
    })


def category_values(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct non-null values.  They become columns, so their number
    is that of a schema's width; use ``label_encode`` for large domains."""
    return sorted(r[0] for r in df.select(F.col(col).cast("string")).where(F.col(col).isNotNull()).distinct().collect())


def onehot(df: DataFrame, col: str, prefix: str, values: list | None = None) -> DataFrame:
    """One int column per sorted category value, 0 for null; original dropped."""
    values = values if values is not None else category_values(df, col)
    dummies = {f"{prefix}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("int")
               for v in values}
    return df.withColumns(dummies).drop(col)


def label_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): dense 0-based codes of the distinct values in order, for any
    number of values: stored in range order, a code is the value's place in its
    range partition plus the partition's offset."""
    values = df.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    stored = cut_lineage(values.repartitionByRange(col).withColumn("_part", F.spark_partition_id()), "codes")
    run = Window.orderBy("_part")  # one row per range partition
    before = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_m")).select(
        "_part", (F.sum("_m").over(run) - F.col("_m")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(col)
    return stored.join(F.broadcast(before), "_part").select(
        col, (F.col("_before") + F.row_number().over(inside) - 1).cast("int").alias(out))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Lexicographic 0-based codes (null stays null), joined from the stored
    dictionary; Spark broadcasts it if its files are small."""
    out = out or f"{col}_encoded"
    codes = label_codes(df, col, out).select(F.col(col).alias("_value"), out)
    return df.join(codes, F.col(col).cast("string") == F.col("_value"), "left").select(*[df[c] for c in df.columns], out)


def encode_categoricals(df: DataFrame) -> DataFrame:
    """Carrier one-hot, airport and season label codes."""
    enc = onehot(df, "carrier_code", "carrier")
    for c in ("origin_airport", "season"):
        enc = label_encode(enc, c)
    return enc


def select_features(df: DataFrame, exclude: list[str] = S.FEATURE_EXCLUDE) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]


def engineered_table(df_clean: DataFrame, regression: bool = False,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned -> engineered: date, features, then target(s); ``keep`` columns
    (e.g. the row key) are carried through first."""
    feat = basic_features(df_clean)
    enc = encode_categoricals(feat)
    cols = [c for c in select_features(enc) if c not in keep]
    targets = [S.TARGET_DELAY] if regression else [S.TARGET_DELAY, S.TARGET_CLASS]
    return enc.select(*keep, "flight_date", *cols, *targets)


def decode_onehot(df: DataFrame, prefix: str = "carrier_", target: str = S.TARGET_DELAY,
                  name: str = "carrier_code") -> DataFrame:
    """Recover the category from the dummy columns and average the target per
    category: one conditional aggregate, then a row per dummy."""
    dummies = [c for c in df.columns if c.startswith(prefix)]
    row = df.agg(*[x for i, c in enumerate(dummies) for x in (
        F.avg(F.when(F.col(f"`{c}`") == 1, F.col(target))).alias(f"m{i}"), F.count_if(F.col(f"`{c}`") == 1).alias(f"n{i}"))])
    structs = [F.struct(F.lit(c[len(prefix):]).alias(name), F.round(f"m{i}", 6).alias("mean_delay"),
                        F.col(f"n{i}").alias("n_flights")) for i, c in enumerate(dummies)]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*").where("n_flights > 0")


def numeric_coerce(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-numeric -> double, bad values -> 0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in cols})


def feature_group(name: str) -> str:
    low = name.lower()
    if "delay" in low:
        return "delay"
    if name.startswith("carrier_"):
        return "carrier"
    if name in OPERATIONAL:
        return "operational"
    if name.endswith("_encoded"):
        return "encoded"
    return "other"


def feature_groups(df: DataFrame) -> DataFrame:
    """Group every feature by name and summarise it (count, mean): one
    aggregate, then a row per feature."""
    cols = [c for c in df.columns if c != "flight_date"]
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(f"`{c}`").alias(f"n{i}"), F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"))])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.round(f"m{i}", 6).alias("mean"),
                        F.lit(feature_group(c)).alias("feature_group")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
