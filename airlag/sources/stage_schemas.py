"""Explicit schemas of the persisted stages (no inference on read)."""

from pyspark.sql import types as T

CLEAN_SCHEMA = T.StructType([
    T.StructField("carrier_code", T.StringType()),
    T.StructField("flight_date", T.DateType()),
    T.StructField("flight_number", T.IntegerType()),
    T.StructField("tail_number", T.StringType()),
    T.StructField("origin_airport", T.StringType()),
    T.StructField("sched_arr_time", T.StringType()),
    T.StructField("actual_arr_time", T.StringType()),
    T.StructField("wheels_on_time", T.StringType()),
    *[T.StructField(c, T.ShortType()) for c in [
        "sched_elapsed_min", "actual_elapsed_min", "arr_delay_min", "taxi_in_min",
        "delay_carrier_min", "delay_weather_min", "delay_nas_min", "delay_security_min",
        "delay_late_aircraft_min"]],
])
