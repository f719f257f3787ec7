"""Incremental ingest of monthly CSV drops with Structured Streaming.

New files landing under ``src`` arrive as whole files in micro-batches, and
each batch goes through the parser of the batch reader.  A batch is written to
a folder of its number, replacing what an interrupted attempt left there, and
the stream's checkpoint records which files were ingested; so a restarted job
(or a lost executor) neither skips nor duplicates a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from airlag.sources.csv_ingest import parse_monthly_lines, with_places


def start_monthly_ingest(spark: SparkSession, src: str, out: str, checkpoint: str,
                         available_now: bool = True, max_files_per_trigger: int = 64) -> StreamingQuery:
    lines = with_places(spark.readStream.format("text")
                        .option("maxFilesPerTrigger", max_files_per_trigger)
                        .option("recursiveFileLookup", "true")
                        .load(src))

    def write(batch: DataFrame, number: int) -> None:
        parse_monthly_lines(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def ingest_until_caught_up(spark: SparkSession, src: str, out: str, checkpoint: str):
    """Run the stream over everything present now, then stop; returns the
    Parquet stage as a batch DataFrame."""
    q = start_monthly_ingest(spark, src, out, checkpoint, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")
