"""Matching outside lists (shop rows, playlists) to the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewave.functions import text as T

GRAM = 3


def _low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def shop_matches(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Shop rows (row_id, ...) with the `ord` of the tracks of equal artist and title, whatever case and blanks; blank
    equals blank. An equi-join, skew is left to adaptive execution."""
    left = rows.withColumns({"_a": _low("artist"), "_t": _low("title")}).drop("artist", "title")
    return left.join(tracks.select("ord", _low("artist").alias("_a"), _low("title").alias("_t")), ["_a", "_t"]).drop("_a", "_t")


def merge_shop(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """(ord, tags, genre, subgenre, rows) of matched tracks: tags of the first matching row where the track has none
    (null), the sorted set of them; genre and subgenre of the last row that has one, else the track's own.

    Shop rows are put together by name first, so each track meets one row: many blank names on both sides cost no more
    than others."""
    filled = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("row_id"))).alias(f"new_{c}")
    named = rows.groupBy(_low("artist").alias("_a"), _low("title").alias("_t"))
    best = named.agg(F.min_by(F.coalesce("tags", F.lit("")), "row_id").alias("first_tags"), filled("genre"), filled("subgenre"), F.count("*").alias("rows"))
    new_tags = F.array_sort(F.array_distinct(T.split_tags(F.col("first_tags"))))
    pick = lambda c: F.when(F.coalesce(F.col(f"new_{c}"), F.lit("")) != "", F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    own = tracks.select("ord", "tags", "genre", "subgenre", _low("artist").alias("_a"), _low("title").alias("_t"))
    return own.join(best, ["_a", "_t"]).select("ord", F.coalesce("tags", new_tags).alias("tags"), pick("genre"), pick("subgenre"), "rows")


def mirror_playlist(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """(ord, first_row) of the tracks that a list of (row_id, artist, title) names: the row's artist and title, stripped and
    in lower case, are parts of the track's; an empty text is part of everything. Sorted by first_row and ord this is the
    playlist, each track once.

    A row looks for tracks by the rarest three letters in a row of its longer text, or by all of it where it is shorter,
    which the track must hold, and compares only with those. The one row without both texts names every track."""
    t = tracks.select("ord", F.lower(F.coalesce("artist", F.lit(""))).alias("ta"), F.lower(F.coalesce("title", F.lit(""))).alias("tt"))
    r = rows.groupBy(_low("artist").alias("ra"), _low("title").alias("rt")).agg(F.min("row_id").alias("row_id"))
    part = (F.col("ra") == "") | F.contains(F.col("ta"), F.col("ra"))
    part = part & ((F.col("rt") == "") | F.contains(F.col("tt"), F.col("rt")))
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))
    field = lambda c, f, n: t.where(F.length(c) >= n).select("ord", F.lit(f).alias("f"), F.explode(grams(F.col(c), n)).alias("g"))
    held = lambda n: field("ta", "a", n).unionByName(field("tt", "t", n))
    by_gram = held(GRAM)
    frequency = by_gram.groupBy("f", "g").agg(F.count("*").alias("n"))
    in_title = F.length("rt") >= F.length("ra")
    looked = r.select("*", F.when(in_title, "t").otherwise("a").alias("f"), F.when(in_title, F.col("rt")).otherwise(F.col("ra")).alias("text"))
    long = looked.where(F.length("text") >= GRAM).withColumn("g", F.explode(grams(F.col("text"), GRAM)))
    rarest = long.join(frequency, ["f", "g"], "left").groupBy("row_id", "ra", "rt", "f").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    short = looked.where((F.length("text") > 0) & (F.length("text") < GRAM)).withColumn("g", F.col("text")).select(*rarest.columns)
    few = by_gram
    for n in range(1, GRAM):
        few = few.unionByName(held(n))
    found = rarest.unionByName(short).join(few, ["f", "g"]).join(t, "ord").where(part).select("ord", "row_id")
    blank = looked.where(F.length("text") == 0).agg(F.min("row_id").alias("row_id")).first()["row_id"]  # one row, if any
    if blank is not None:
        found = found.unionByName(t.select("ord", F.lit(blank).cast("bigint").alias("row_id")))
    return found.groupBy("ord").agg(F.min("row_id").alias("first_row"))
