"""DJ collection files in XML: reading the tags of tracks, writing a collection with playlists.

Tracks are rows; their XML is built where the rows are, and only the final single file is put together part by part on
the driver, as a stream, because the format is one file."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewave.functions import text as T
from cratewave.operators import catalog, knn

TRACK_SCHEMA = "_Location string, MY_TAG struct<TAG: array<struct<_Name: string>>>"


def read_tags(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(path, tags) of the tracks of a collection file that have a location and tags that are not blank; of a repeated
    path the last one counts. With `known` (path), other tracks are left out."""
    rows = spark.read.format("xml").option("rowTag", "TRACK").schema(TRACK_SCHEMA).load(path)
    named = rows.select(T.location_path(F.col("_Location")).alias("path"), F.filter(F.transform("MY_TAG.TAG", lambda t: F.trim(t["_Name"])), lambda t: t.isNotNull() & (t != "")).alias("tags"), F.monotonically_increasing_id().alias("at"))
    good = named.where("path is not null and path <> '' and size(tags) > 0").groupBy("path").agg(F.max_by("tags", "at").alias("tags"))
    return good if known is None else good.join(known.select("path"), "path", "left_semi")


def export_rows(tracks: DataFrame) -> DataFrame:
    """Rows of a collection: track_id in catalog order, names, key, tempo, location, sorted tags."""
    rows = knn.number(tracks, "ord")
    opt = lambda c: F.col(c) if c in tracks.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("position").alias("track_id"), "ord", F.coalesce("title", F.lit("")).alias("name"), F.coalesce("artist", F.lit("")).alias("artist"), opt("genre").alias("genre"), opt("grouping").alias("grouping"),
        opt("comments").alias("comments"), F.col("camelot").alias("tonality"), F.col("bpm").alias("average_bpm"), T.location_uri(F.col("path")).alias("location"), F.array_sort(F.array_distinct(T.clean_tags(F.col("mytags")))).alias("my_tags"),
    )


def _attribute(name: str, value: Column) -> Column:
    text = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f' {name}="'), text, F.lit('"'))).otherwise("")


def fragments(rows: DataFrame) -> DataFrame:
    """(track_id, xml): one TRACK element per row, with one TEMPO where the tempo is known, and its tags. Decimals are
    rounded half to even."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                tempo = f'<TEMPO Inizio="0.000" Bpm="{r["average_bpm"]:.2f}" Metro="4/4" Battito="1"/>' if r["average_bpm"] else ""
                bpm = f' AverageBpm="{r["average_bpm"]:.2f}"' if r["average_bpm"] else ""
                quote = {'"': "&quot;"}
                tags = "".join(f'<TAG Name="{escape(t, quote)}"/>' for t in r["my_tags"])
                out.append(f"{r['head']}{bpm}>{tempo}{f'<MY_TAG>{tags}</MY_TAG>' if tags else ''}</TRACK>")
            yield pa.RecordBatch.from_arrays([b.column("track_id"), pa.array(out, pa.string())], ["track_id", "xml"])

    names = (("TrackID", "track_id"), ("Name", "name"), ("Artist", "artist"), ("Genre", "genre"), ("Grouping", "grouping"), ("Comments", "comments"), ("Tonality", "tonality"), ("Location", "location"))
    head = F.concat(F.lit("<TRACK"), *[_attribute(n, F.col(c)) for n, c in names])
    return rows.select("track_id", head.alias("head"), "average_bpm", "my_tags").mapInArrow(build, "track_id bigint, xml string")


def write_collection(tracks: DataFrame, path: str, playlist: str | None = None) -> int:
    """Write one collection file with all tracks, the registry of tags and, if named, a playlist of all tracks; returns
    the number of tracks. Elements are streamed partition by partition."""
    rows = export_rows(tracks)
    n = rows.count()
    tags = catalog.tag_registry(tracks).orderBy("tag_id")
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<DJ_PLAYLISTS Version="1.0.0"><PRODUCT Name="cratewave" Version="0.1"/><COLLECTION Entries="{n}"><MY_TAGS>')
        quote = {'"': "&quot;"}
        for r in tags.toLocalIterator():
            out.write(f'<TAG ID="{r["tag_id"]}" Name="{escape(r["tag"], quote)}"/>')
        out.write("</MY_TAGS>\n")
        for r in fragments(rows).orderBy("track_id").toLocalIterator():
            out.write(r["xml"] + "\n")
        out.write(f'</COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT" Count="{1 if playlist else 0}">')
        if playlist:
            out.write(f'<NODE Type="1" Name="{escape(playlist, quote)}" KeyType="1" Entries="{n}">')
            for r in rows.select("track_id", "location").orderBy("track_id").toLocalIterator():
                out.write(f'<TRACK Key="{escape(r["location"], quote)}"/>')
            out.write("</NODE>")
        out.write("</NODE></PLAYLISTS></DJ_PLAYLISTS>\n")
    return n
