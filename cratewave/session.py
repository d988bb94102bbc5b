"""Session construction and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of a session, once per application, so that they can import it wherever
    the driver was started. The archive is served by the driver; workers need no shared path for it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(package):  # not already an archive
            folder = tempfile.mkdtemp(prefix="cratewave-package-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            stage = os.path.join(folder, "stage")
            shutil.copytree(package, os.path.join(stage, "cratewave"), ignore=shutil.ignore_patterns("__pycache__"))
            context.addPyFile(shutil.make_archive(os.path.join(folder, "cratewave"), "zip", stage))
            shutil.rmtree(stage)
    return spark


def local_session(cpus: int = 8, memory: str = "8g", app: str = "cratewave") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
