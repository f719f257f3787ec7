"""Column expressions: pure ``Column -> Column`` helpers, all JVM-side."""

from airlag.functions.calendar import (  # noqa: F401
    day_of_week, is_holiday_period, is_weekend, season, year_month,
)
from airlag.functions.hashing import hash_bucket, hash32, row_key  # noqa: F401
from airlag.functions.nulls import null_count, null_name_list  # noqa: F401
from airlag.functions.targets import delay_bucket3, delay_bucket4, is_delayed  # noqa: F401
