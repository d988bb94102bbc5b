"""Accepted and rejected suggestions: logs, namespaces of tags, and the style they teach.

State is never changed in place: every action takes tables and returns new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correction_stats(log: DataFrame) -> DataFrame:
    """One row: entries, accepted, rejected."""
    return log.agg(F.count("*").alias("total"), F.count_if(F.col("action") == "accepted").alias("accepted"), F.count_if(F.col("action") == "rejected").alias("rejected"))


def latest_suggestions(log: DataFrame) -> DataFrame:
    """(path, tag, confidence): the last known confidence of each suggested tag, from entries with a track."""
    order = F.struct("logged_at", "log_id")
    return log.where(F.col("track").isNotNull() & F.col("confidence").between(0, 1)).groupBy(F.col("track").alias("path"), F.trim("tag").alias("tag")).agg(F.max_by("confidence", order).alias("confidence"))


def suggestion_stats(suggestions: DataFrame) -> DataFrame:
    """One row: tracks with suggestions, and suggestions."""
    return suggestions.agg(F.countDistinct("path").alias("tracks"), F.count("*").alias("suggestions"))


def at_least(suggestions: DataFrame, min_confidence: float) -> DataFrame:
    """Suggestions of a confidence; a bound of 0 or less keeps all."""
    return suggestions.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else suggestions


def review_list(suggestions: DataFrame, min_confidence: float = 0.5, limit: int = 20) -> DataFrame:
    """(path, rank, tag, confidence) of the first `limit` tracks by path, their tags from the most confident on."""
    kept = at_least(suggestions, min_confidence)
    first = kept.select("path").distinct().orderBy("path").limit(limit)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("confidence"), "tag"))
    return kept.join(first, "path", "left_semi").withColumn("rank", rank).select("path", "rank", "tag", "confidence")


def tag_usage(track_tags: DataFrame) -> DataFrame:
    """(tag, n) of (path, pos, tag) rows."""
    return track_tags.groupBy("tag").agg(F.count("*").alias("n"))


def tag_pairs(track_tags: DataFrame, group: str = "ord") -> DataFrame:
    """(tag_a, tag_b, n): how often two tags stand on one track, in either order; a tag that stands twice pairs with
    itself. The pairs of one track come from its own list, so no join is needed."""
    lists = track_tags.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t")).select(F.col("t.tag").alias("t"))
    left = lists.select("t", F.posexplode("t").alias("i", "a"))
    both = left.select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))
    return both.groupBy(F.least("a", "b").alias("tag_a"), F.greatest("a", "b").alias("tag_b")).agg(F.count("*").alias("n"))


def most_used(usage: DataFrame, k: int = 10) -> DataFrame:
    """(rank, tag, n) of the tags in most use."""
    order = [F.desc("n"), "tag"]
    return usage.orderBy(*order).limit(k).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "tag", "n")


def complementary(pairs: DataFrame, tags: list[str], k: int = 10) -> DataFrame:
    """(rank, tag, n) of the tags that stand most often beside the given ones, without these."""
    both = pairs.where(F.col("tag_a").isin(tags)).select(F.col("tag_b").alias("tag"), "n").unionByName(pairs.where(F.col("tag_b").isin(tags)).select(F.col("tag_a").alias("tag"), "n"))
    order = [F.desc("n"), "tag"]
    few = both.where(~F.col("tag").isin(tags)).groupBy("tag").agg(F.sum("n").alias("n")).orderBy(*order).limit(k)
    return few.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "tag", "n")


def preference(usage: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the `preferred` of two tags by use, null on a tie."""
    n = lambda t: F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("n"))), F.lit(0))
    return usage.agg(n(a).alias("n_a"), n(b).alias("n_b")).select(F.when(F.col("n_a") > F.col("n_b"), a).when(F.col("n_b") > F.col("n_a"), b).alias("preferred"), "n_a", "n_b")


def substitutions(log: DataFrame) -> DataFrame:
    """(tag, user_chose): what the user last put in place of each rejected tag, where it differs."""
    wrong = log.where((F.col("action") == "rejected") & F.col("user_chose").isNotNull() & (F.col("user_chose") != F.col("tag")))
    return wrong.groupBy("tag").agg(F.max_by("user_chose", F.struct("logged_at", "log_id")).alias("user_chose"))


def confusion(log: DataFrame) -> DataFrame:
    """(tag, user_chose, n) over rejected entries with the user's own choice."""
    return log.where((F.col("action") == "rejected") & F.col("user_chose").isNotNull()).groupBy("tag", "user_chose").agg(F.count("*").alias("n"))


def accuracy(log: DataFrame) -> DataFrame:
    """One row: entries with the user's own choice, how many of them equal the suggestion, and their share (0 of none)."""
    chosen = log.where(F.col("user_chose").isNotNull() & F.col("tag").isNotNull())
    return chosen.agg(F.count("*").alias("total"), F.count_if(F.col("tag") == F.col("user_chose")).alias("agreed")).select("total", "agreed", F.round(F.coalesce(F.try_divide(F.col("agreed"), F.col("total")), F.lit(0.0)), 6).alias("accuracy"))


def most_corrected(log: DataFrame, k: int = 10) -> DataFrame:
    """(rank, tag, n) of the tags that were replaced most often."""
    wrong = log.where((F.col("action") == "rejected") & F.col("user_chose").isNotNull() & (F.col("user_chose") != F.col("tag"))).groupBy("tag").agg(F.count("*").alias("n"))
    return most_used(wrong, k)


def style_usage(track_tags: DataFrame, log: DataFrame) -> DataFrame:
    """(tag, n): tags in use plus accepted suggestions, and the user's own choices where a suggestion was rejected."""
    learned = log.select(F.when(F.col("action") == "accepted", F.col("tag")).when(F.col("action") == "rejected", F.col("user_chose")).alias("tag")).where("tag is not null")
    return tag_usage(track_tags.select("tag").unionByName(learned))


def adjust(suggestions: DataFrame, swaps: DataFrame, usage: DataFrame, min_usage: int = 2) -> DataFrame:
    """(path, tag, confidence): suggestions bent to the user's style. A tag with a substitution becomes it at 1.2 times the
    confidence; another gains 0.01 per use, 0.1 at most; all end at 1. Tags used less than `min_usage` times fall away.
    Where two tags of a track become one, the later tag in the alphabet is kept."""
    n = usage.select("tag", "n")
    bent = suggestions.join(swaps, "tag", "left").join(n, "tag", "left").select(
        "path", F.col("tag").alias("was"), F.coalesce("user_chose", "tag").alias("tag"),
        F.when(F.col("user_chose").isNotNull(), F.least(F.lit(1.0), F.col("confidence") * 1.2)).otherwise(F.least(F.lit(1.0), F.col("confidence") + F.least(F.lit(0.1), F.coalesce("n", F.lit(0)) * 0.01))).alias("confidence"),
    )
    one = bent.groupBy("path", "tag").agg(F.max_by("confidence", "was").alias("confidence"))
    return one.join(n.where(F.col("n") >= min_usage).select("tag"), "tag", "left_semi").select("path", "tag", "confidence")


def unused(vocabulary: DataFrame, usage: DataFrame) -> DataFrame:
    """Tags of a vocabulary that nothing uses."""
    return vocabulary.select("tag").join(usage.select("tag"), "tag", "left_anti")


def overlap(user_tags: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(path, n, tags) where a suggestion repeats a tag of the user's own: what a safety check reports."""
    both = user_tags.select("path", "tag").distinct().join(suggestions.select("path", "tag").distinct(), ["path", "tag"])
    return both.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))


def combined(user_tags: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(path, tag, source): all tags of a track; a suggested one counts as "ai" even if the user has it, too."""
    both = user_tags.select("path", "tag", F.lit("user").alias("source")).unionByName(suggestions.select("path", "tag", F.lit("ai").alias("source")))
    return both.groupBy("path", "tag").agg(F.min("source").alias("source"))


def accept(user_tags: DataFrame, suggestions: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user tags, suggestions, log entries) after accepting `actions` (path, tag). Actions without such a suggestion do
    nothing."""
    hit = suggestions.join(actions.select("path", "tag").distinct(), ["path", "tag"], "left_semi")
    tags = user_tags.select("path", "tag").unionByName(hit.select("path", "tag")).distinct()
    rest = suggestions.join(actions.select("path", "tag"), ["path", "tag"], "left_anti")
    return tags, rest, hit.select("path", "tag", "confidence", F.lit("accepted").alias("action"), F.lit(None).cast("string").alias("reason"))


def reject(suggestions: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions, log entries) after rejecting `actions` (path, tag, reason)."""
    wanted = actions.groupBy("path", "tag").agg(F.max("reason").alias("reason"))
    hit = suggestions.join(wanted, ["path", "tag"])
    return suggestions.join(wanted, ["path", "tag"], "left_anti"), hit.select("path", "tag", "confidence", F.lit("rejected").alias("action"), "reason")


def migrate(old: DataFrame) -> DataFrame:
    """(path, tags) of an old store (path, tag): sorted distinct tags."""
    return old.where("tag is not null").groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def set_tags(store: DataFrame, changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, tags) store after setting the tags of `changes` (path, tags); empty tags clear a track, and with `known`
    (path) unknown tracks are skipped."""
    new = changes if known is None else changes.join(known.select("path"), "path", "left_semi")
    kept = store.join(new.select("path"), "path", "left_anti")
    return kept.unionByName(new.where(F.size("tags") > 0).select("path", F.array_distinct("tags").alias("tags")))


def add_tag(user_tags: DataFrame, path: str, tag: str, source: str = "user") -> DataFrame:
    """User tags (path, tag) with one more; suggested tags have to be accepted instead and raise ValueError."""
    if source == "ai":
        raise ValueError("a suggestion is accepted, not added")
    return user_tags.select("path", "tag").unionByName(user_tags.sparkSession.createDataFrame([(path, tag)], "path string, tag string")).distinct()


def remove_tag(user_tags: DataFrame, path: str, tag: str) -> DataFrame:
    """User tags without one of a track; one that is not there changes nothing."""
    return user_tags.where(~((F.col("path") == path) & (F.col("tag") == tag)))


def available(new: list[str], old: list[str]) -> list[str]:
    """Tags to choose from: new ones first, each once."""
    return list(dict.fromkeys([*new, *old]))
