"""Small generators for repetitive oracle SQL."""

from __future__ import annotations

NUMERIC_CLEAN = [
    "flight_number", "sched_elapsed_min", "actual_elapsed_min", "arr_delay_min",
    "taxi_in_min", "delay_carrier_min", "delay_weather_min", "delay_nas_min",
    "delay_security_min", "delay_late_aircraft_min",
]
CLEAN_COLS = [
    "carrier_code", "flight_date", "flight_number", "tail_number", "origin_airport",
    "sched_arr_time", "actual_arr_time", "wheels_on_time", *NUMERIC_CLEAN[1:],
]
# all columns of the cleaned table, in order
CLEAN_ORDER = [
    "carrier_code", "flight_date", "flight_number", "tail_number", "origin_airport",
    "sched_arr_time", "actual_arr_time", "wheels_on_time", "sched_elapsed_min",
    "actual_elapsed_min", "arr_delay_min", "taxi_in_min", "delay_carrier_min",
    "delay_weather_min", "delay_nas_min", "delay_security_min", "delay_late_aircraft_min",
]
CARRIERS = ["HI", "LO", "ME", "NO", "UR"]


def iqr_cte(table: str, cols: list[str], k: float = 1.5, name: str = "_b") -> str:
    parts = []
    for c in cols:
        q1 = f"quantile_cont({c}, 0.25)"
        q3 = f"quantile_cont({c}, 0.75)"
        parts.append(f"{q1} - {k} * ({q3} - {q1}) AS lo_{c}, {q3} + {k} * ({q3} - {q1}) AS hi_{c}")
    return f"{name} AS (SELECT {', '.join(parts)} FROM {table})"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"
