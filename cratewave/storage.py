"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table, so a lost executor costs a re-read instead of a recomputation. The folder is the
cluster's `spark.checkpoint.dir`; only where that is unset and the master is one machine (tests) a temporary folder of
this machine is made and set; on a cluster without the setting an error is raised. Tables stay readable as long as the
program runs and are deleted at its end, or before by `discard`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cratewave-")
        _own.append(folder)
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to a fresh table of the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _written.append((spark, path))
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; what is written there is deleted at the end of the program."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that `materialize` returned and that nothing will read again, such as those of a round gone by."""
    for table in tables:
        path = getattr(table, "_table_path", None)
        if path:
            _written.remove((table.sparkSession, path))
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """`df` over all cores where its input has fewer splits than the cluster has cores; else `df` itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:  # the session may have ended before
            _delete(spark, path)
        except Exception:
            break
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)
