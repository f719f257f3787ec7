"""Shared inputs for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlag.operators import cleaning as CL
from airlag.operators import features as FE
from airlag.plans.preprocess import preprocess
from airlag.session import cut_lineage, delete_folder
from airlag.sources.driver_tables import flights_raw


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return flights_raw(spark, sf)


def dated(spark, sf) -> DataFrame:
    return CL.canonical_date(raw(spark, sf))


def valid(spark, sf) -> DataFrame:
    return CL.remove_invalid_rows(dated(spark, sf))


#: Cleaned stages by (application, folder, variant, state of the input files).
_STAGES: dict[tuple, DataFrame] = {}
_INPUTS = ("lineitem", "orders", "supplier", "nation")


def _changed(spark: SparkSession, sf: str) -> tuple:
    """Modification times of the input tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in _INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf}/{t}.parquet")
        out.append(path.getFileSystem(conf).getFileStatus(path).getModificationTime())
    return tuple(out)


def _stage(spark: SparkSession, sf: str, regression: bool) -> DataFrame:
    """The cleaned table, written once per input and session: its statistics,
    join and de-duplication are shared by all reports, which then read the
    columns that they need."""
    key = (spark.sparkContext.applicationId, sf, regression, _changed(spark, sf))
    if key not in _STAGES:
        # the regression variant is the cleaned table cut to the target range
        _STAGES[key] = CL.clip_target_range(clean(spark, sf), cap_min=-60, cap_max=300) if regression \
            else cut_lineage(preprocess(raw(spark, sf)), "cleaned")
    return _STAGES[key]


def release_stages(spark: SparkSession) -> int:
    """Delete the session's cleaned stages (results that still read them must
    be stored by then); later reports write them anew."""
    mine = [k for k in _STAGES if k[0] == spark.sparkContext.applicationId]
    for folder in {_STAGES.pop(k).inputFiles()[0].rsplit("/", 1)[0] for k in mine}:
        delete_folder(spark, folder)
    return len(mine)


def clean(spark, sf) -> DataFrame:
    return _stage(spark, sf, False)


def clean_regression(spark, sf) -> DataFrame:
    return _stage(spark, sf, True)


def featured(spark, sf) -> DataFrame:
    return FE.basic_features(clean(spark, sf))


def engineered(spark, sf, regression: bool = False) -> DataFrame:
    src = clean_regression(spark, sf) if regression else clean(spark, sf)
    return FE.engineered_table(src, regression=regression)


# ---------------------------------------------------------------- model data
from pyspark.sql import functions as F  # noqa: E402

from airlag.operators.splits import add_row_key, split_random  # noqa: E402
from airlag.plans.sqlgen import CLEAN_ORDER  # noqa: E402


def keyed_clean(spark, sf, regression: bool = False) -> DataFrame:
    """Cleaned records with ``row_key`` (md5 of all columns), computed before
    feature selection drops the identifiers."""
    src = clean_regression(spark, sf) if regression else clean(spark, sf)
    return add_row_key(src, CLEAN_ORDER)


def engineered_keyed(spark, sf, regression: bool = False) -> DataFrame:
    return FE.engineered_table(keyed_clean(spark, sf, regression), regression, keep=("row_key",))


def planted_signal(df: DataFrame):
    """Fixed integer linear form of the engineered features (a stand-in model)."""
    return ((F.col("sched_elapsed_min") - 180) + 40 * F.col("is_weekend")
            + 25 * F.col("is_holiday_period") - 15 * F.col("season_encoded")
            + 7 * F.col("origin_airport_encoded") + 20 * F.col("carrier_UR")
            - 10 * F.col("carrier_LO"))


def scored(spark, sf) -> DataFrame:
    """Prediction frame: row_key, split, y, score, yhat, y_reg, yhat_reg."""
    e = split_random(engineered_keyed(spark, sf))
    x = planted_signal(e)
    score = F.lit(0.5) + F.lit(0.5) * x.cast("double") / (F.lit(100) + F.abs(x)).cast("double")
    return e.select("row_key", "split", F.col("is_delayed").alias("y"), score.alias("score"),
                    (score > 0.5).cast("int").alias("yhat"),
                    F.col("arr_delay_min").alias("y_reg"), (x / F.lit(4.0)).alias("yhat_reg"))
