"""Model-time column selection (estimators live in ``plans.estimators``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

# --- fixed values: columns never used as model inputs -----------------------
MODEL_EXCLUDE = ["flight_date", "arr_delay_min", "is_delayed", "row_key", "split", "fold",
                 "weight", "label", "features"]
# ----------------------------------------------------------------------------


def model_columns(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c not in MODEL_EXCLUDE and c != target]
