"""Session helpers.

Library code never creates its own session; it takes the one it is given.
``get_session`` is for tests, the bench and scripts.  ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session (the shared folder the cluster names)
and only falls back to a local folder when the setting is absent, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "airlag") -> SparkSession:
    master = master or os.environ.get("AIRLAG_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AIRLAG_DRIVER_MEM", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names.  Only a session that
    runs in one process (``local[...]``, as in tests) may leave it unset; it
    then gets a temporary folder.  On a cluster a folder of one machine would
    lose data, so an unset folder is an error there."""
    sc = spark.sparkContext
    current = spark.conf.get(_CKPT_KEY, None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="airlag-ckpt-")
    spark.conf.set(_CKPT_KEY, local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the session's checkpoint
    folder and return a scan of it.

    Used before iterative work (model fitting, repeated passes) so that later
    jobs, and any recomputation after a lost executor, start from the written
    table, not from the raw scan, join and de-duplication.  Unlike
    ``DataFrame.checkpoint`` (an RDD checkpoint that evaluates the plan twice
    unless cached) this computes the plan once, and the re-read table keeps
    column pruning and predicate pushdown.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def stored(df: DataFrame, name: str = "stage"):
    """``cut_lineage`` for statistics that are fetched inside the block: the
    table is deleted at its end."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        delete_folder(spark, path)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()  # fits run in several threads


def ship_package(spark: SparkSession) -> None:
    """Make ``airlag`` importable in executor Python workers (needed by the
    operators that run NumPy inside tasks).  The zip is built on the driver
    and ``addPyFile`` serves it to every executor, also to those that join
    later, so no shared folder is involved."""
    sc = spark.sparkContext
    with _SHIPPING:
        if sc.applicationId in _SHIPPED:
            return
        import zipfile

        import airlag
        pkg = os.path.dirname(os.path.abspath(airlag.__file__))
        root = os.path.dirname(pkg)
        zpath = os.path.join(tempfile.mkdtemp(prefix="airlag-pkg-"), "airlag.zip")
        with zipfile.ZipFile(zpath, "w") as z:
            for dirpath, _, files in os.walk(pkg):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(zpath)
        _SHIPPED.add(sc.applicationId)
