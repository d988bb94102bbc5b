"""Duplicate tracks: by names and length, or by content; which copy to keep; where to move the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewave.functions import text as T


def names_key(tracks: DataFrame) -> DataFrame:
    """`tracks` with a `dup_key` of artist, title and length; missing parts count as empty and 0."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return tracks.withColumn("dup_key", F.concat_ws("\x1f", low("artist"), low("title"), F.coalesce("duration", F.lit(0)).cast("string")))


def content_key(rows: DataFrame, content: str) -> DataFrame:
    """`rows` with the SHA-1 of their content as `dup_key`; rows without content are left out."""
    return rows.where(F.col(content).isNotNull()).withColumn("dup_key", F.sha1(F.col(content).cast("binary")))


def keep_best(keyed: DataFrame, lossless: str = "lossless", bitrate: str = "bitrate", order: str = "ord") -> DataFrame:
    """(keep, lose): for each row of a duplicate group but the best, the best and the row. Lossless copies go first, then
    the higher bitrate, then the earlier row.

    The best of a group is an aggregate, which combines before it is shuffled, so a group with a third of all rows needs
    no sort in one task."""
    rank = F.struct(F.coalesce(F.col(lossless), F.lit(0)), F.coalesce(F.col(bitrate), F.lit(0)), -F.col(order))
    best = keyed.groupBy("dup_key").agg(F.max_by(order, rank).alias("keep"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(best, "dup_key").where(F.col(order) != F.col("keep")).select("keep", F.col(order).alias("lose"))


def groups(keyed: DataFrame, order: str = "ord") -> DataFrame:
    """(first, n) of every group of at least two rows."""
    return keyed.groupBy("dup_key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("first", "n")


def stage_plan(losers: DataFrame, dest: str) -> DataFrame:
    """(ord, path, target) of files to stage: the file name under `dest`, with _1, _2, ... before the suffix where an
    earlier one took it."""
    name = losers.withColumn("name", T.basename(F.col("path")))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("ord")) - 1
    tail = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    free = F.when(F.col("nth") == 0, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), F.col("nth").cast("string"), tail))
    return name.withColumn("nth", nth).select("ord", "path", F.concat(F.lit(dest.rstrip("/") + "/"), free).alias("target"))


def player_warnings(rows: DataFrame, sample_rate: str = "sample_rate", most: int = 96_000) -> DataFrame:
    """`ord`, `path` and a warning for sample rates that players may not support; missing rates count as 0."""
    rate = F.coalesce(F.col(sample_rate), F.lit(0))
    return rows.where(rate > most).select("ord", "path", F.concat(F.lit("Sample rate "), rate.cast("string"), F.lit("Hz may be unsupported")).alias("warning"))


def stage(plan: DataFrame, move: bool = False, dry_run: bool = False) -> DataFrame:
    """(ord, path, target, status) after copying or moving the files of a `stage_plan` on a file system that all tasks
    share; files that are missing are skipped, and with `dry_run` nothing is touched. Runs when the result is read. A file is
    written beside its target under a name of its own and renamed at the end, and a moved one is deleted only then: tasks
    that run twice, also at once, leave one whole target, and find it and count it as done."""
    import os
    import shutil
    import uuid

    import pyarrow as pa

    def work(batches):
        for b in batches:
            status = []
            for path, target in zip(b.column("path").to_pylist(), b.column("target").to_pylist()):
                if not os.path.exists(path):
                    status.append("success" if move and os.path.exists(target) else "skipped")
                elif dry_run:
                    status.append("planned")
                else:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{uuid.uuid4().hex}"
                    try:
                        shutil.copy2(path, part)
                        os.replace(part, target)
                        if move:
                            os.unlink(path)
                        status.append("success")
                    except FileNotFoundError:  # another run of the task has just moved it
                        if os.path.exists(part):
                            os.unlink(part)
                        status.append("success" if os.path.exists(target) else "skipped")
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("path"), b.column("target"), pa.array(status, pa.string())], ["ord", "path", "target", "status"])

    return plan.select("ord", "path", "target").mapInArrow(work, "ord bigint, path string, target string, status string")
