"""Contiguous shards of nearly equal bytes.

Rows are ordered by id.  A range partitioning gives every partition one
interval of that order; its byte and row totals (one row per partition) turn
into prefix sums, and a running sum inside each partition completes the global
byte offset of every row.  The offsets are cut at equal targets.  Only ids,
sizes and checksums are shuffled, never texts, and no task sees more than one
interval.  Rows that share an id are ordered by checksum and read position, so
a hot id spreads over many intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag.llm.common import read_table, scratch

N_SHARDS = 24
ROW_OVERHEAD = 8


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id",
               text_col: str = "text", overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Shard of every row by the law ``bytes``.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    ``size`` is the UTF-8 length plus ``overhead``; a row goes to the shard in
    whose byte interval its middle lies, so shard sizes differ from the equal
    target by at most half a row at each end.  ``slot`` numbers the rows of a
    shard from 0 in id order.

    Null texts have no bytes (checksum 0), null ids come first, repeated rows
    are placed one by one, an empty table gives no rows, and other columns of
    ``docs`` are ignored whatever their names.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "text_crc32", "row"]
    parts = scratch(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shards")

    # one row per range partition, so this window over all of them is small
    run, every = Window.orderBy("part"), Window.partitionBy()
    totals = (parts.groupBy("part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
              .select("part", (F.sum("b").over(run) - F.col("b")).alias("bytes_before"),
                      (F.sum("r").over(run) - F.col("r")).alias("rows_before"),
                      F.sum("b").over(every).alias("all_bytes")))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (parts.withColumns({"b": F.sum("size").over(inside), "r": F.row_number().over(inside)})
              .join(F.broadcast(totals), "part")
              .withColumns({"before": F.col("bytes_before") + F.col("b") - F.col("size"),
                            "position": F.col("rows_before") + F.col("r") - 1})
              .withColumn("shard", F.expr(
                  f"cast(least({n_shards - 1}L, ((2 * before + size) * {n_shards}L) div "
                  "greatest(2 * all_bytes, 1L)) as int)")))
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet folders ``shard=0 .. n-1`` (ids must be unique
    and not null here, since placements are joined back by id)."""
    where = shard_rows(docs, n_shards, id_col).select(F.col("doc_id").alias(id_col), "shard")
    docs.join(where, id_col).repartitionByRange("shard", id_col).write.partitionBy("shard").parquet(path)


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"))
