"""Driver tables and the on-time record table derived from them.

The flight records are a deterministic projection of
``lineitem JOIN orders JOIN supplier JOIN nation``: one record per line item,
with null and duplicate rules that exercise every cleaning step.  The rules
only ever *add* nulls or copies; no row of the source is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.operators.joins import broadcast_if_bounded

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# --- fixed values: fixture rules (key modulus -> effect) ---------------------
INVALID_MOD = 503        # l_orderkey: every column but tail_number null
TAIL_NULL_MOD = 97       # l_orderkey: tail_number null
DUPLICATE_MOD = 211      # l_orderkey: record appears twice
TAXI_NULL_MOD = 89       # l_orderkey: taxi_in_min null
TIMES_NULL_MOD = 61      # l_orderkey: actual_arr_time, wheels_on_time null
AIRPORT_NULL_MOD = 113   # l_partkey: origin_airport null
WEATHER_NULL_MOD = 71    # l_partkey: delay_weather_min null
DELAY_DIVISOR = 8.0      # days between order and ship date per delay minute
CAUSE_MIN_DELAY = 15
CAUSE_FLAGS = {"delay_carrier_min": "A", "delay_weather_min": "N",
               "delay_late_aircraft_min": "R"}
# ----------------------------------------------------------------------------

# Supplier x nation is joined by broadcast only while it has at most this many
# rows; beyond that the planner's shuffle join is used.
SUPPLIER_BROADCAST_ROWS = 1_000_000
NATION_BROADCAST_ROWS = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hhmm(hours: Column, minutes: Column) -> Column:
    return F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(minutes.cast("string"), 2, "0"))


def flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw on-time records (17 columns, date as an M/D/Y string)."""
    # Hash-partition the fact side on the join key: for big inputs this is the
    # exchange the lineitem-orders sort-merge join needs anyway (the planner
    # reuses it), and it spreads a few large files over every core.
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_shipdate").repartition("l_orderkey")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # nation is the fixed 25-row dimension (TPC-H), still checked before the hint.
    nation = broadcast_if_bounded(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
                                  NATION_BROADCAST_ROWS)
    supp_nation = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey) \
        .select("s_suppkey", "n_name")
    supp_nation = broadcast_if_bounded(supp_nation, SUPPLIER_BROADCAST_ROWS)

    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .join(supp_nation, li.l_suppkey == supp_nation.s_suppkey))

    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    invalid = (ok % INVALID_MOD) == 0
    delay = F.floor(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
                    / F.lit(DELAY_DIVISOR)).cast("int")
    sched = (F.floor("l_quantity").cast("int") * 6 + 30)

    def keep(value: Column, null_if: Column | None = None) -> Column:
        cond = invalid if null_if is None else (invalid | null_if)
        return F.when(~cond, value)

    def cause(flag: str) -> Column:
        return F.when((delay >= CAUSE_MIN_DELAY) & (F.col("l_returnflag") == flag),
                      delay).otherwise(F.lit(0))

    out = j.select(
        keep(F.substring("o_orderpriority", 3, 2)).alias("carrier_code"),
        keep(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("date_mdy"),
        keep(pk.cast("int")).alias("flight_number"),
        F.when((ok % TAIL_NULL_MOD) != 0,
               F.concat(F.lit("N"), sk.cast("string"))).alias("tail_number"),
        keep(F.col("n_name"), (pk % AIRPORT_NULL_MOD) == 0).alias("origin_airport"),
        keep(_hhmm(pk % 24, ok % 60)).alias("sched_arr_time"),
        keep(_hhmm((pk + F.col("l_linenumber")) % 24, (ok + sk) % 60),
             (ok % TIMES_NULL_MOD) == 0).alias("actual_arr_time"),
        keep(_hhmm(sk % 24, pk % 60), (ok % TIMES_NULL_MOD) == 0).alias("wheels_on_time"),
        keep(sched).cast("short").alias("sched_elapsed_min"),
        keep(sched + delay).cast("short").alias("actual_elapsed_min"),
        keep(delay).cast("short").alias("arr_delay_min"),
        keep(F.col("l_linenumber") + 3, (ok % TAXI_NULL_MOD) == 0).cast("short")
        .alias("taxi_in_min"),
        keep(cause(CAUSE_FLAGS["delay_carrier_min"])).cast("short").alias("delay_carrier_min"),
        keep(cause(CAUSE_FLAGS["delay_weather_min"]), (pk % WEATHER_NULL_MOD) == 0)
        .cast("short").alias("delay_weather_min"),
        keep(F.lit(0)).cast("short").alias("delay_nas_min"),
        keep(F.lit(0)).cast("short").alias("delay_security_min"),
        keep(cause(CAUSE_FLAGS["delay_late_aircraft_min"])).cast("short")
        .alias("delay_late_aircraft_min"),
        # copies: one extra record per duplicated line item, no union re-scan
        F.explode(F.sequence(F.lit(1), F.when((ok % DUPLICATE_MOD) == 0, F.lit(2))
                             .otherwise(F.lit(1)))).alias("_copy"),
    )
    return out.drop("_copy")
