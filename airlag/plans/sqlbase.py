"""Plain-SQL forms of the base tables, for independent checks.

Each constant is a list of ``name AS (...)`` common table expressions over the
driver tables (``lineitem``, ``orders``, ``supplier``, ``nation``).  Oracle
queries are ``with_ctes(<ctes>) + SELECT ...``.  The SQL is written for DuckDB
(``quantile_cont``, ``mode``, ``try_strptime``).
"""

from __future__ import annotations

RAW = [
    """_li AS (
  SELECT l.l_orderkey AS ok, l.l_partkey AS pk, l.l_suppkey AS sk,
         l.l_linenumber AS ln, l.l_quantity AS qty, l.l_returnflag AS rf,
         l.l_shipdate AS shipdate, o.o_orderpriority AS prio, n.n_name AS n_name,
         CAST(floor(datediff('day', CAST(o.o_orderdate AS DATE),
                             CAST(l.l_shipdate AS DATE)) / 8.0) AS INTEGER) AS dly,
         (l.l_orderkey % 503 = 0) AS inv
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)""",
    """_base AS (
  SELECT ok,
    CASE WHEN NOT inv THEN substr(prio, 3, 2) END AS carrier_code,
    CASE WHEN NOT inv THEN strftime(shipdate, '%m/%d/%Y') END AS date_mdy,
    CASE WHEN NOT inv THEN CAST(pk AS INTEGER) END AS flight_number,
    CASE WHEN ok % 97 <> 0 THEN 'N' || CAST(sk AS VARCHAR) END AS tail_number,
    CASE WHEN NOT (inv OR pk % 113 = 0) THEN n_name END AS origin_airport,
    CASE WHEN NOT inv THEN lpad(CAST(pk % 24 AS VARCHAR), 2, '0') || ':'
                        || lpad(CAST(ok % 60 AS VARCHAR), 2, '0') END AS sched_arr_time,
    CASE WHEN NOT (inv OR ok % 61 = 0)
         THEN lpad(CAST((pk + ln) % 24 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST((ok + sk) % 60 AS VARCHAR), 2, '0') END AS actual_arr_time,
    CASE WHEN NOT (inv OR ok % 61 = 0)
         THEN lpad(CAST(sk % 24 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST(pk % 60 AS VARCHAR), 2, '0') END AS wheels_on_time,
    CAST(CASE WHEN NOT inv THEN CAST(floor(qty) AS INTEGER) * 6 + 30 END AS SMALLINT)
      AS sched_elapsed_min,
    CAST(CASE WHEN NOT inv THEN CAST(floor(qty) AS INTEGER) * 6 + 30 + dly END AS SMALLINT)
      AS actual_elapsed_min,
    CAST(CASE WHEN NOT inv THEN dly END AS SMALLINT) AS arr_delay_min,
    CAST(CASE WHEN NOT (inv OR ok % 89 = 0) THEN ln + 3 END AS SMALLINT) AS taxi_in_min,
    CAST(CASE WHEN NOT inv THEN CASE WHEN dly >= 15 AND rf = 'A' THEN dly ELSE 0 END END
      AS SMALLINT) AS delay_carrier_min,
    CAST(CASE WHEN NOT (inv OR pk % 71 = 0)
              THEN CASE WHEN dly >= 15 AND rf = 'N' THEN dly ELSE 0 END END
      AS SMALLINT) AS delay_weather_min,
    CAST(CASE WHEN NOT inv THEN 0 END AS SMALLINT) AS delay_nas_min,
    CAST(CASE WHEN NOT inv THEN 0 END AS SMALLINT) AS delay_security_min,
    CAST(CASE WHEN NOT inv THEN CASE WHEN dly >= 15 AND rf = 'R' THEN dly ELSE 0 END END
      AS SMALLINT) AS delay_late_aircraft_min
  FROM _li)""",
    """raw AS (
  SELECT * EXCLUDE (ok) FROM _base
  UNION ALL
  SELECT * EXCLUDE (ok) FROM _base WHERE ok % 211 = 0)""",
]

RAW_COLS_SQL = (
    "carrier_code, date_mdy, flight_number, tail_number, origin_airport, "
    "sched_arr_time, actual_arr_time, wheels_on_time, sched_elapsed_min, "
    "actual_elapsed_min, arr_delay_min, taxi_in_min, delay_carrier_min, "
    "delay_weather_min, delay_nas_min, delay_security_min, delay_late_aircraft_min"
)
DATED_COLS_SQL = RAW_COLS_SQL.replace("date_mdy", "flight_date")

# canonical date, moved to second position
DATED = RAW + [
    """dated AS (
  SELECT carrier_code,
         CAST(try_strptime(date_mdy, '%m/%d/%Y') AS DATE) AS flight_date,
         flight_number, tail_number, origin_airport, sched_arr_time, actual_arr_time,
         wheels_on_time, sched_elapsed_min, actual_elapsed_min, arr_delay_min,
         taxi_in_min, delay_carrier_min, delay_weather_min, delay_nas_min,
         delay_security_min, delay_late_aircraft_min
  FROM raw)""",
]

_NULLS15 = " + ".join(
    f"CAST({c} IS NULL AS INTEGER)" for c in [
        "flight_number", "flight_date", "origin_airport", "sched_arr_time",
        "actual_arr_time", "sched_elapsed_min", "actual_elapsed_min", "arr_delay_min",
        "wheels_on_time", "taxi_in_min", "delay_carrier_min", "delay_weather_min",
        "delay_nas_min", "delay_security_min", "delay_late_aircraft_min"])

VALID = DATED + [f"valid AS (SELECT * FROM dated WHERE ({_NULLS15}) < 10)"]

# numeric columns holding nulls after invalid-row removal: taxi_in_min and
# delay_weather_min (the fixture's partial-null rules); they become DOUBLE.
IMPUTED = VALID + [
    """_istats AS (
  SELECT quantile_cont(taxi_in_min, 0.5) AS m_taxi,
         quantile_cont(delay_weather_min, 0.5) AS m_weather,
         (SELECT origin_airport FROM valid WHERE origin_airport IS NOT NULL
          GROUP BY origin_airport ORDER BY count(*) DESC, origin_airport LIMIT 1) AS m_airport,
         (SELECT carrier_code FROM valid WHERE carrier_code IS NOT NULL
          GROUP BY carrier_code ORDER BY count(*) DESC, carrier_code LIMIT 1) AS m_carrier
  FROM valid)""",
    """imputed AS (
  SELECT coalesce(carrier_code, m_carrier) AS carrier_code, flight_date, flight_number,
         coalesce(tail_number, 'Unknown') AS tail_number,
         coalesce(origin_airport, m_airport) AS origin_airport,
         sched_arr_time, actual_arr_time, wheels_on_time, sched_elapsed_min,
         actual_elapsed_min, arr_delay_min,
         coalesce(CAST(taxi_in_min AS DOUBLE), m_taxi) AS taxi_in_min,
         delay_carrier_min,
         coalesce(CAST(delay_weather_min AS DOUBLE), m_weather) AS delay_weather_min,
         delay_nas_min, delay_security_min, delay_late_aircraft_min
  FROM valid CROSS JOIN _istats)""",
]

DEDUP = IMPUTED + ["dedup AS (SELECT DISTINCT * FROM imputed)"]

# validate types: integers back to their width (fractional fill values are
# rounded half away from zero first)
CLEAN = DEDUP + [
    """clean AS (
  SELECT carrier_code, flight_date, flight_number, tail_number, origin_airport,
         sched_arr_time, actual_arr_time, wheels_on_time, sched_elapsed_min,
         actual_elapsed_min, arr_delay_min,
         TRY_CAST(round(taxi_in_min) AS SMALLINT) AS taxi_in_min,
         delay_carrier_min,
         TRY_CAST(round(delay_weather_min) AS SMALLINT) AS delay_weather_min,
         delay_nas_min, delay_security_min, delay_late_aircraft_min
  FROM dedup)""",
]

CLEAN_REGRESSION = CLEAN[:-1] + [
    CLEAN[-1].replace("clean AS (", "_clean0 AS (", 1),
    "clean AS (SELECT * FROM _clean0 WHERE arr_delay_min BETWEEN -60 AND 300)",
]

FEATURES = CLEAN + [
    """feat AS (
  SELECT *,
    CAST(month(flight_date) AS INTEGER) AS month,
    CAST(day(flight_date) AS INTEGER) AS day,
    CAST(isodow(flight_date) - 1 AS INTEGER) AS day_of_week,
    CAST(coalesce(isodow(flight_date) - 1 >= 5, false) AS INTEGER) AS is_weekend,
    CAST(coalesce(
        (month(flight_date) = 11 AND day(flight_date) BETWEEN 22 AND 28)
     OR (month(flight_date) = 12 AND day(flight_date) >= 20)
     OR (month(flight_date) = 1 AND day(flight_date) <= 5)
     OR (month(flight_date) = 7 AND day(flight_date) BETWEEN 1 AND 7)
     OR (month(flight_date) = 5 AND day(flight_date) >= 25)
     OR (month(flight_date) = 9 AND day(flight_date) BETWEEN 1 AND 7), false) AS INTEGER)
      AS is_holiday_period,
    CASE WHEN month(flight_date) IN (12, 1, 2) THEN 'Winter'
         WHEN month(flight_date) IN (3, 4, 5) THEN 'Spring'
         WHEN month(flight_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
    CAST(coalesce(arr_delay_min > 15, false) AS INTEGER) AS is_delayed
  FROM clean)""",
]


def with_ctes(ctes: list[str]) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
