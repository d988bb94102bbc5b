"""Streams: counts over the correction log, upkeep of the vector index, deck polling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewave.operators import knn

LOG_SCHEMA = "log_id bigint, logged_at timestamp, received_at timestamp, track string, action string, tag string, confidence double, reason string, user_chose string"


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The correction log as a stream of the Parquet files of a folder."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def action_counts(log: DataFrame, window: str = "1 day", late: str = "45 days") -> DataFrame:
    """(start, action, n): entries per window of the time they were logged. Rows may arrive weeks late: the watermark keeps
    windows open that long, and rows that come later still are dropped. Repeated log_ids count once within it."""
    once = log.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["log_id"])
    return once.groupBy(F.window("logged_at", window).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def usage_counts(log: DataFrame) -> DataFrame:
    """(tag, accepted, rejected) over the whole stream: one state per tag of a vocabulary."""
    return log.groupBy(F.trim("tag").alias("tag")).agg(F.count_if(F.col("action") == "accepted").alias("accepted"), F.count_if(F.col("action") == "rejected").alias("rejected"))


def keep_index(stream: DataFrame, folder: str, checkpoint: str):
    """Extend an index of (label, path) below a folder by the tracks (ord, path) of a stream, batch by batch; a batch that
    is repeated after a failure adds nothing. Returns the started query, which ends when all input is read."""
    from cratewave.sources.catalog import read_version, write_version

    def extend(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = read_version(spark, folder).select("label", "path")
        except Exception as error:  # no version yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old = spark.createDataFrame([], "label bigint, path string")
        fresh = batch.where("path is not null").groupBy("path").agg(F.min("ord").alias("ord"))
        write_version(knn.extend_index(old, fresh), folder)

    return stream.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deck_source():
    """A streaming source of deck states for `spark.dataSource.register`: polls a function given as module:name that
    returns (player, title, artist, tempo) of the players that are online."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, poll: str) -> None:
            self.poll = poll

        def initialOffset(self) -> dict:
            return {"at": 0}

        def read(self, start: dict):
            import importlib

            module, _, name = self.poll.partition(":")
            rows = [(start["at"], *r) for r in getattr(importlib.import_module(module), name)()]
            return iter(rows), {"at": start["at"] + 1}

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter([])

        def commit(self, end: dict) -> None:
            pass

    class Decks(DataSource):
        @classmethod
        def name(cls) -> str:
            return "decks"

        def schema(self) -> str:
            return "poll bigint, player int, title string, artist string, tempo double"

        def simpleStreamReader(self, schema) -> Reader:
            return Reader(self.options["poll"])

    return Decks
