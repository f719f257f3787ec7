"""Cleaning and feature pipelines (each step switchable)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from airlag.operators import cleaning as CL
from airlag.operators import features as FE


def preprocess(df: DataFrame, remove_invalid: bool = True, handle_missing: bool = True,
               remove_dupes: bool = True, validate_dtypes: bool = True,
               outliers: str = "keep", date_range=None, regression: bool = False,
               cap_min: float = -60, cap_max: float = 300) -> DataFrame:
    """date -> invalid rows -> date range -> impute -> dedup -> types ->
    (regression: target range) -> outliers.  The records are stored before
    the steps that read them more than once."""
    df = CL.canonical_date(df)
    if remove_invalid:
        df = CL.remove_invalid_rows(df)
    if date_range:
        df = CL.filter_date_range(df, *date_range)
    if handle_missing:
        df = CL.handle_missing(df)
    if remove_dupes:
        df = CL.drop_duplicates(df, stored=handle_missing)
    if validate_dtypes:
        df = CL.validate_types(df)
    if regression:
        df = CL.clip_target_range(df, cap_min=cap_min, cap_max=cap_max)
    if outliers != "keep":
        df = CL.handle_outliers(df, method=outliers)
    return df


def preprocess_regression(df: DataFrame, **kw) -> DataFrame:
    return preprocess(df, regression=True, **kw)


def engineer(df_clean: DataFrame, regression: bool = False) -> DataFrame:
    return FE.engineered_table(df_clean, regression=regression)
