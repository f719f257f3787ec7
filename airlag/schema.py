"""Column model of the on-time records.

Inside the library every column has a snake_case name; ``ORIGINAL_NAMES`` maps
them to the published header so exports can use the original names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: published header names of the raw records -----------------
ORIGINAL_NAMES = {
    "carrier_code": "Carrier Code",
    "date_mdy": "Date (MM/DD/YYYY)",
    "flight_date": "Date (YYYY-MM-DD)",
    "flight_number": "Flight Number",
    "tail_number": "Tail Number",
    "origin_airport": "Origin Airport",
    "sched_arr_time": "Scheduled Arrival Time",
    "actual_arr_time": "Actual Arrival Time",
    "wheels_on_time": "Wheels-on Time",
    "sched_elapsed_min": "Scheduled Elapsed Time (Minutes)",
    "actual_elapsed_min": "Actual Elapsed Time (Minutes)",
    "arr_delay_min": "Arrival Delay (Minutes)",
    "taxi_in_min": "Taxi-In time (Minutes)",
    "delay_carrier_min": "Delay Carrier (Minutes)",
    "delay_weather_min": "Delay Weather (Minutes)",
    "delay_nas_min": "Delay National Aviation System (Minutes)",
    "delay_security_min": "Delay Security (Minutes)",
    "delay_late_aircraft_min": "Delay Late Aircraft Arrival (Minutes)",
}
HEADER_PREFIX = "Carrier Code,Date"
# ----------------------------------------------------------------------------

SNAKE_NAMES = {v: k for k, v in ORIGINAL_NAMES.items()}

DELAY_CAUSE_COLS = [
    "delay_carrier_min", "delay_weather_min", "delay_nas_min",
    "delay_security_min", "delay_late_aircraft_min",
]
TIME_STRING_COLS = ["sched_arr_time", "actual_arr_time", "wheels_on_time"]
SHORT_COLS = [
    "sched_elapsed_min", "actual_elapsed_min", "arr_delay_min", "taxi_in_min",
    *DELAY_CAUSE_COLS,
]
INT_COLS = ["flight_number", *SHORT_COLS]
CATEGORICAL_COLS = ["carrier_code", "origin_airport"]
TARGET_DELAY = "arr_delay_min"
TARGET_CLASS = "is_delayed"

# Raw record order as read from a monthly file (date still the M/D/Y string).
RAW_COLS = [
    "carrier_code", "date_mdy", "flight_number", "tail_number", "origin_airport",
    "sched_arr_time", "actual_arr_time", "wheels_on_time",
    "sched_elapsed_min", "actual_elapsed_min", "arr_delay_min", "taxi_in_min",
    *DELAY_CAUSE_COLS,
]

_TYPES = {
    "carrier_code": T.StringType(), "date_mdy": T.StringType(),
    "flight_date": T.DateType(), "flight_number": T.IntegerType(),
    "tail_number": T.StringType(), "origin_airport": T.StringType(),
    **{c: T.StringType() for c in TIME_STRING_COLS},
    **{c: T.ShortType() for c in SHORT_COLS},
}

RAW_SCHEMA = T.StructType([T.StructField(c, _TYPES[c], True) for c in RAW_COLS])
# All-string form used by the CSV reader before typed validation.
RAW_STRING_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLS])

# Columns whose nulls mark an invalid record (date is added when present).
CRITICAL_COLS = [
    "flight_number", "origin_airport", *TIME_STRING_COLS,
    "sched_elapsed_min", "actual_elapsed_min", "arr_delay_min", "taxi_in_min",
    *DELAY_CAUSE_COLS,
]
INVALID_NULL_LIMIT = 10

# --- fixed values: feature selection exclude lists ---------------------------
FEATURE_EXCLUDE = [
    "arr_delay_min", "is_delayed",
    "actual_arr_time", "actual_elapsed_min", "wheels_on_time", "taxi_in_min",
    "delay_carrier_min", "delay_weather_min", "delay_nas_min",
    "delay_security_min", "delay_late_aircraft_min",
    "origin_airport", "season",
    "tail_number", "flight_number", "flight_date",
    "sched_arr_time",
    "month", "day", "day_of_week",
]
# ----------------------------------------------------------------------------


def original_name(col: str) -> str:
    return ORIGINAL_NAMES.get(col, col)


def has_time_in_original_name(col: str) -> bool:
    """Categorical imputation skips columns whose published name has 'Time'."""
    return "Time" in original_name(col)
