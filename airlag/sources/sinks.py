"""Stage, summary and report sinks.

Stages are Parquet folders by default (CSV as an export option).  Summaries
are one row per model run.  An append never touches what is there: its rows are
written to a folder that readers pass over and renamed, which is atomic, to a
name of their own.  A job that is killed leaves the summary as it was or with
all its rows, and appends at the same time keep each other's rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag import schema as S


def write_stage(df: DataFrame, path: str, fmt: str = "parquet",
                original_names: bool = False, partition_by: list[str] | None = None) -> str:
    out = df
    if original_names:
        out = df.select(*[F.col(c).alias(S.original_name(c)) for c in df.columns])
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def load_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    if fmt == "csv":
        from airlag.sources.stage_schemas import CLEAN_SCHEMA
        return spark.read.schema(schema or CLEAN_SCHEMA).option("header", True).csv(path)
    return spark.read.parquet(path)


def merge_summary(existing: DataFrame | None, new_rows: DataFrame) -> DataFrame:
    """Existing summary + new rows; metrics absent on either side -> null."""
    if existing is None:
        return new_rows
    return existing.unionByName(new_rows, allowMissingColumns=True)


def _entries(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """The summary at ``path``, None if there is none yet: what ``write_summary``
    wrote and all finished appends, in one scan each; columns that a run lacks
    are null."""
    path = path.rstrip("/")
    written, appended = _entries(spark, f"{path}/*.csv"), _entries(spark, f"{path}/rows-*")
    base = spark.read.option("header", True).csv(written) if written else None
    if not appended:
        return base
    return merge_summary(base, spark.read.option("primitivesAsString", True).json(appended))


def append_summary(new_rows: DataFrame, path: str) -> str:
    """Append rows to the summary at ``path``, creating it when absent."""
    spark = new_rows.sparkSession
    text = new_rows.select(*[F.col(c).cast("string").alias(c) for c in new_rows.columns])
    name = uuid.uuid4().hex
    pending, final = f"{path.rstrip('/')}/_pending-{name}", f"{path.rstrip('/')}/rows-{name}"
    text.coalesce(1).write.option("ignoreNullFields", False).json(pending)
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (pending, final))
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"cannot move {pending} to {final}")
    return path


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)
    return path


def report_frame(spark: SparkSession, metrics: dict, config: dict, timestamp: str,
                 task: str) -> DataFrame:
    """One row with nested metric/config structs, ready for ``write.json``."""
    rec = {"task": task, "timestamp": timestamp, "metrics": metrics,
           "config": {k: (json.dumps(v) if isinstance(v, (list, dict)) else v)
                      for k, v in config.items()}}
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(rec)], 1))


def write_json_report(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").json(path)
    return path
