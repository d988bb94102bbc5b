"""Operators on the track catalog: views, searches, work selection, rules, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewave.functions import text as T


def latest(tracks: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """One row per key, the last by `order`; null keys are one group. Built as an aggregate, so hot keys combine early."""
    rest = [c for c in tracks.columns if c not in (key, order)]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("row")
    return tracks.groupBy(key).agg(F.max(order).alias(order), best).select(*[F.col(c) if c in (key, order) else F.col(f"row.{c}").alias(c) for c in tracks.columns])


def library_table(tracks: DataFrame, embedded: DataFrame) -> DataFrame:
    """What a library view shows of each track. `embedded` has the `ord` of tracks with a usable vector; missing titles
    show the file name, a missing or zero tempo shows null."""
    tags = F.when(F.size(T.clean_tags(F.col("mytags"))) > 0, T.clean_tags(F.col("mytags"))).otherwise(T.clean_tags(F.col("tags")))
    has = lambda c: F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")
    analysed = (F.coalesce("bpm", F.lit(0.0)) != 0) & (F.coalesce("camelot", F.lit("")) != "")
    return tracks.join(embedded.select("ord", F.lit(True).alias("has_vector")).distinct(), "ord", "left").select(
        "ord", F.coalesce("artist", F.lit("")).alias("artist"), F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(T.basename(F.col("path"))).alias("title"),
        F.when(F.coalesce("bpm", F.lit(0.0)) != 0, F.bround("bpm", 0).cast("int")).alias("bpm_shown"), has(F.col("has_vector")).alias("embedded"), has(analysed).alias("analysed"),
        F.array_join(tags, ", ").alias("tags_shown"),
    )


def counts(tracks: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: tracks, those with a vector, those with tempo and key."""
    analysed = (F.coalesce("bpm", F.lit(0.0)) != 0) & (F.coalesce("camelot", F.lit("")) != "")
    return tracks.join(embedded.select("ord", F.lit(1).alias("v")).distinct(), "ord", "left").agg(
        F.count("*").alias("total"), F.count("v").alias("embedded"), F.count_if(analysed).alias("analysed")
    )


def search(tracks: DataFrame, term: str) -> DataFrame:
    """Tracks whose artist, title or tags hold a text, whatever its case; a blank text finds all. Wildcards are literal."""
    needle = term.strip().lower()
    if not needle:
        return tracks
    fields = [F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit("")), F.array_join(T.clean_tags(F.col("mytags")), " ")]
    return tracks.where(reduce(lambda a, b: a | b, [F.contains(F.lower(f), F.lit(needle)) for f in fields]))


def seed_options(tracks: DataFrame, term: str, limit: int = 100) -> DataFrame:
    """The first tracks in catalog order whose label or path holds a text: a list to choose a seed from."""
    shown = F.when(F.coalesce("artist", F.lit("")) != "", T.label(F.col("artist"), F.col("title"))).otherwise(F.coalesce("title", F.lit("")))
    found = tracks.withColumn("label", shown)
    needle = term.strip().lower()
    if needle:
        found = found.where(F.contains(F.lower("label"), F.lit(needle)) | F.contains(F.lower("path"), F.lit(needle)))
    return found.orderBy("ord").limit(limit).select("ord", "path", "label")


def needs_analysis(tracks: DataFrame, only_new: bool = False, force: bool = False, signatures: DataFrame | None = None) -> DataFrame:
    """Tracks that analysis has to visit: all with `force`; with `only_new`, those without tempo and key or with another
    signature than the stored one (`signatures`: path, signature, stored); else those that lack tempo or key."""
    if force:
        return tracks
    done = (F.coalesce("bpm", F.lit(0.0)) != 0) & (F.coalesce("camelot", F.lit("")) != "")
    if only_new and signatures is not None:
        return tracks.join(signatures.select("path", (F.col("signature") == F.col("stored")).alias("same")), "path", "left").where(~(done & F.coalesce("same", F.lit(False)))).drop("same")
    return tracks.where(~done)


def folder_mode(tracks: DataFrame, rules: list[tuple[str, str]], default: str = "baseline") -> DataFrame:
    """`ord`, `path` and the mode of the first rule (prefix, mode) that the path starts with, whatever its case."""
    norm = lambda s: s.replace("\\", "/").rstrip("/").lower()
    path = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    mode = F.lit(default)
    for prefix, m in reversed(rules):
        mode = F.when(F.startswith(path, F.lit(norm(prefix))), m).otherwise(mode)
    return tracks.select("ord", "path", mode.alias("mode"))


def upsert_rule(rules: list[tuple[str, str]], prefix: str, mode: str) -> list[tuple[str, str]]:
    """Rules with one set at the front; an older rule of the same prefix, whatever its case, is dropped."""
    norm = lambda s: s.replace("\\", "/").rstrip("/").lower()
    return [(prefix, mode), *[r for r in rules if norm(r[0]) != norm(prefix)]]


def classify_files(paths: DataFrame, rules: list[tuple[str, str]], column: str = "path") -> DataFrame:
    """`column` and the `dest` of the first rule (pattern, folder) that the file name matches; null if none does."""
    name = T.basename(F.col(column))
    dest: Column = F.lit(None).cast("string")
    for pattern, folder in reversed(rules):
        dest = F.when(name.rlike(pattern), folder).otherwise(dest)
    return paths.select(column, dest.alias("dest"))


def merge_analysis(tracks: DataFrame, results: DataFrame) -> DataFrame:
    """Catalog with analysis results (path, artist, title, bpm, camelot, samples): tempo and key are overwritten, names
    and features only filled in. Rows without a result stay."""
    r = results.select("path", *[F.col(c).alias(f"new_{c}") for c in ("artist", "title", "bpm", "camelot", "samples")])
    joined = tracks.join(r, "path", "left")
    new = {c: F.coalesce(f"new_{c}", c) for c in ("bpm", "camelot")} | {c: F.coalesce(c, f"new_{c}") for c in ("artist", "title", "samples")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in tracks.columns])


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with `rows` in place of those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def playlist(tracks: DataFrame, tag: str | None = None, rating_min: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Tracks that carry a tag, have at least a rating (missing counts as 0) and were added within dates. Rules that are
    None or empty are left out; unreadable dates pass."""
    out = tracks
    if tag:
        out = out.where(F.array_contains(T.clean_tags(F.col("mytags")), tag))
    if rating_min is not None:
        out = out.where(F.coalesce("rating", F.lit(0)) >= rating_min)
    return out.where(T.within_dates(F.col("added"), since, until))


def tag_registry(tracks: DataFrame) -> DataFrame:
    """Every tag in use with its number in alphabetical order, from 1. Tags are made distinct before they are numbered,
    so the numbering is over the vocabulary only."""
    tags = tracks.select(F.explode(T.clean_tags(F.col("mytags"))).alias("tag")).distinct()
    return tags.withColumn("tag_id", F.row_number().over(Window.orderBy("tag")))
