"""Queries through sources, sinks and streams: what was written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cratewave.functions import text as T
from cratewave.plans import register, sql
from cratewave.plans.library import tracks, vectors
from cratewave.session import table
from cratewave.sources import catalog as C
from cratewave.sources import signal
from cratewave.storage import scratch
from cratewave.streaming import logs

query, QUERIES, ORACLES = register()


@query("catalog_versions", "SELECT ord, path, artist, array_to_string(mytags, '|') AS mytags FROM tracks WHERE ord % 3 <> 0")
def catalog_versions(spark, d):
    folder = scratch(spark, "versions")
    C.write_version(tracks(spark, d).select("ord", "path", "artist", "mytags"), folder)
    C.write_version(C.read_version(spark, folder).where("ord % 3 <> 0"), folder)
    return C.read_version(spark, folder).select("ord", "path", "artist", F.array_join("mytags", "|").alias("mytags"))


@query("csv_rows", "SELECT artist, title, tags, NULL::VARCHAR AS missing, count(*) AS n FROM (SELECT NULLIF(artist, '') AS artist, NULLIF(trim(title), '') AS title, NULLIF(tags, '') AS tags FROM shop_rows) GROUP BY ALL")
def csv_rows(spark, d):
    folder = scratch(spark, "csv")
    C.write_csv(table(spark, d, "shop_rows").select("artist", F.trim("title").alias("title"), "tags"), folder)
    rows = C.read_csv(spark, folder, {"artist": "Artist", "title": "TITLE", "tags": "tags", "missing": "none"})
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return rows.select(blank("artist"), blank("title"), blank("tags"), "missing").groupBy("artist", "title", "tags", "missing").agg(F.count("*").alias("n"))


@query("staged_tags", f"SELECT regexp_replace(replace(path, '\\', '/'), '/+', '/', 'g') AS path, array_to_string(list_sort(list_distinct(flatten(list(l)))), '|') AS tags FROM (SELECT path, {sql.tags('mytags')} AS l FROM tracks) WHERE path IS NOT NULL AND len(l) > 0 GROUP BY 1")
def staged_tags(spark, d):
    rows = tracks(spark, d).select("path", F.explode("mytags").alias("tag"))
    return C.staged_tags(rows).select("path", F.array_join("tags", "|").alias("tags"))


@query("stem_cache", """WITH p AS (SELECT 'song_' || (ord % 50) || '_' || (CASE WHEN ord % 2 = 0 THEN 'fine' ELSE 'fast' END) AS folder, 'part' || (ord % 7) AS stem FROM tracks)
  SELECT regexp_replace(folder, '_[^_]*$', '') AS name, string_split(folder, '_')[3] AS model, array_to_string(list_sort(list_distinct(list(stem))), '|') AS stems, count(DISTINCT stem) AS n FROM p GROUP BY folder""")
def stem_cache(spark, d):
    model = F.when(F.col("ord") % 2 == 0, "fine").otherwise("fast")
    path = F.concat(F.lit("/stems/song_"), (F.col("ord") % 50).cast("string"), F.lit("_"), model, F.lit("/part"), (F.col("ord") % 7).cast("string"), F.lit(".wav"))
    return C.stem_cache(tracks(spark, d).select(path.alias("path"))).select("name", "model", F.array_join("stems", "|").alias("stems"), "n")


@query("stage_counts", """WITH r AS (SELECT CASE WHEN ord % 2 = 0 THEN 'embed' ELSE 'analyze' END AS stage, bpm, camelot FROM tracks)
  SELECT stage, count(*) FILTER (WHERE bpm > 0) AS success, count(*) FILTER (WHERE NOT coalesce(bpm > 0, false) AND camelot IS NULL) AS errors, count(*) FILTER (WHERE NOT coalesce(bpm > 0, false) AND camelot IS NOT NULL) AS skipped FROM r GROUP BY stage""")
def stage_counts(spark, d):
    status = F.when(F.col("bpm") > 0, "success").when(F.col("camelot").isNull(), "error").otherwise("skipped")
    return C.stage_counts(tracks(spark, d).select(F.when(F.col("ord") % 2 == 0, "embed").otherwise("analyze").alias("stage"), status.alias("status")))


@query("first_sound", f"WITH {sql.VECTORS} SELECT ord, round(coalesce(nullif(list_position(list_transform(v, lambda x: abs(x) > 0.15), true), 0) - 1, 0) / 4.0::DOUBLE, 6) AS t FROM v")
def first_sound(spark, d):
    return vectors(spark, d).select("ord", F.round(signal.first_sound(F.col("v"), F.lit(4), 0.15), 6).alias("t"))


@query("stream_usage", "SELECT trim(tag) AS tag, count(*) FILTER (WHERE action = 'accepted') AS accepted, count(*) FILTER (WHERE action = 'rejected') AS rejected FROM correction_log GROUP BY 1")
def stream_usage(spark, d):
    """The whole log through a stream that ends with its input; its last batch is the answer. The log is named by a
    pattern, so that it may be one file or a folder of files."""
    folder = scratch(spark, "usage")
    counts = logs.usage_counts(logs.read_log(spark, f"{d}/correction_log.parque[t]"))

    def keep(batch, _):
        C.write_version(batch, folder)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "usage-state")).trigger(availableNow=True).start().awaitTermination()
    return C.read_version(spark, folder)


@query("profile_windows", None)
def profile_windows(spark, d):
    """Windows to sample, with the events of a user as onsets of a track, one a second."""
    from cratewave.plans.series import series

    onsets = series(spark, d).select("path", "t", "x")
    lengths = onsets.groupBy("path").agg((F.max("t") + 1).alias("duration"))
    return signal.profile_windows(onsets, lengths)


@query("media_suffixes", "SELECT lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) AS suffix, count(*) AS n FROM tracks WHERE path IS NOT NULL GROUP BY 1")
def media_suffixes(spark, d):
    return tracks(spark, d).where("path is not null").groupBy(T.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"))
