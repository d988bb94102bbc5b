"""Queries on accepted and rejected suggestions and the style they teach."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewave.functions import scores as S
from cratewave.functions import text as T
from cratewave.operators import feedback as B
from cratewave.plans import register, sql
from cratewave.plans.library import tracks
from cratewave.session import table

query, QUERIES, ORACLES = register()

_LOG = "lg AS (SELECT *, trim(tag) AS tg FROM correction_log)"
_SUGG = "sg AS (SELECT track AS path, trim(tag) AS tag, confidence FROM (SELECT *, row_number() OVER (PARTITION BY track, trim(tag) ORDER BY logged_at DESC NULLS LAST, log_id DESC) AS rn FROM correction_log WHERE track IS NOT NULL AND confidence BETWEEN 0 AND 1) WHERE rn = 1)"
_TT = f"tt AS ({sql.exploded()})"
_USE = "us AS (SELECT tag, count(*) AS n FROM tt GROUP BY tag)"
_PAIRS = "pa AS (SELECT least(a.tag, b.tag) AS tag_a, greatest(a.tag, b.tag) AS tag_b, count(*) AS n FROM tt a JOIN tt b ON a.ord = b.ord AND a.pos < b.pos GROUP BY 1, 2)"
_SUBS = "su AS (SELECT tag, user_chose FROM (SELECT trim(tag) AS tag, user_chose, row_number() OVER (PARTITION BY trim(tag) ORDER BY logged_at DESC NULLS LAST, log_id DESC) AS rn FROM correction_log WHERE action = 'rejected' AND user_chose IS NOT NULL AND user_chose <> trim(tag)) WHERE rn = 1)"
_STYLE = "st AS (SELECT tag, count(*) AS n FROM (SELECT tag FROM tt UNION ALL SELECT CASE action WHEN 'accepted' THEN tg WHEN 'rejected' THEN user_chose END AS tag FROM lg) WHERE tag IS NOT NULL GROUP BY tag)"
_UT = f"ut AS (SELECT DISTINCT t.path, e.tag FROM ({sql.exploded()}) e JOIN tracks t USING (ord))"


def log(spark, d):
    return table(spark, d, "correction_log").withColumn("tag", F.trim("tag"))


def suggestions(spark, d):
    return B.latest_suggestions(table(spark, d, "correction_log"))


def track_tags(spark, d):
    return tracks(spark, d).select("ord", F.posexplode(T.clean_tags(F.col("mytags"))).alias("pos", "tag"))


def user_tags(spark, d):
    return tracks(spark, d).select("path", F.explode(T.clean_tags(F.col("mytags"))).alias("tag")).distinct()


@query("correction_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE action = 'accepted') AS accepted, count(*) FILTER (WHERE action = 'rejected') AS rejected FROM correction_log")
def correction_stats(spark, d):
    return B.correction_stats(log(spark, d))


@query("suggestion_stats", f"WITH {_SUGG} SELECT count(DISTINCT path) AS tracks, count(*) AS suggestions FROM sg")
def suggestion_stats(spark, d):
    return B.suggestion_stats(suggestions(spark, d))


@query("suggestions_confident", f"WITH {_SUGG} SELECT path, tag, confidence FROM sg WHERE confidence >= 0.8")
def suggestions_confident(spark, d):
    return B.at_least(suggestions(spark, d), 0.8)


@query("review_list", f"""WITH {_SUGG}, k AS (SELECT * FROM sg WHERE confidence >= 0.5), f AS (SELECT DISTINCT path FROM k ORDER BY path LIMIT 20)
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, tag) AS rank, tag, confidence FROM k WHERE path IN (SELECT path FROM f)""")
def review_list(spark, d):
    return B.review_list(suggestions(spark, d))


@query("user_tags", f"WITH {_UT} SELECT tag, count(*) AS tracks FROM ut GROUP BY tag")
def user_tag_list(spark, d):
    return user_tags(spark, d).groupBy("tag").agg(F.count("*").alias("tracks"))


@query("tag_usage", f"WITH {_TT}, {_USE} SELECT tag, n FROM us")
def tag_usage(spark, d):
    return B.tag_usage(track_tags(spark, d))


@query("tag_pairs", f"WITH {_TT}, {_PAIRS} SELECT tag_a, tag_b, n FROM pa")
def tag_pairs(spark, d):
    return B.tag_pairs(track_tags(spark, d))


@query("most_used", f"WITH {_TT}, {_USE} SELECT row_number() OVER (ORDER BY n DESC, tag) AS rank, tag, n FROM us ORDER BY n DESC, tag LIMIT 10")
def most_used(spark, d):
    return B.most_used(B.tag_usage(track_tags(spark, d)))


_GIVEN = ["After Hours", "Lift"]


@query("complementary", f"""WITH {_TT}, {_PAIRS}, b AS (SELECT tag_b AS tag, n FROM pa WHERE tag_a IN ('After Hours', 'Lift') UNION ALL SELECT tag_a, n FROM pa WHERE tag_b IN ('After Hours', 'Lift')),
  g AS (SELECT tag, sum(n)::BIGINT AS n FROM b WHERE tag NOT IN ('After Hours', 'Lift') GROUP BY tag) SELECT row_number() OVER (ORDER BY n DESC, tag) AS rank, tag, n FROM g ORDER BY n DESC, tag LIMIT 10""")
def complementary(spark, d):
    return B.complementary(B.tag_pairs(track_tags(spark, d)), _GIVEN)


@query("tag_preference", f"WITH {_TT}, p AS (SELECT count(*) FILTER (WHERE tag = 'After Hours') AS n_a, count(*) FILTER (WHERE tag = 'Lift') AS n_b FROM tt) SELECT CASE WHEN n_a > n_b THEN 'After Hours' WHEN n_b > n_a THEN 'Lift' END AS preferred, n_a, n_b FROM p")
def tag_preference(spark, d):
    return B.preference(B.tag_usage(track_tags(spark, d)), "After Hours", "Lift")


@query("substitutions", f"WITH {_SUBS} SELECT tag, user_chose FROM su")
def substitutions(spark, d):
    return B.substitutions(log(spark, d))


@query("confusion_matrix", f"WITH {_LOG} SELECT tg AS tag, user_chose, count(*) AS n FROM lg WHERE action = 'rejected' AND user_chose IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return B.confusion(log(spark, d))


@query("correction_accuracy", f"""WITH {_LOG}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE tg = user_chose) AS agreed FROM lg WHERE user_chose IS NOT NULL AND tg IS NOT NULL)
  SELECT total, agreed, round(coalesce(agreed::DOUBLE / nullif(total, 0), 0), 6) AS accuracy FROM c""")
def correction_accuracy(spark, d):
    return B.accuracy(log(spark, d))


@query("most_corrected", f"""WITH {_LOG}, w AS (SELECT tg AS tag, count(*) AS n FROM lg WHERE action = 'rejected' AND user_chose IS NOT NULL AND user_chose <> tg GROUP BY tg)
  SELECT row_number() OVER (ORDER BY n DESC, tag) AS rank, tag, n FROM w ORDER BY n DESC, tag LIMIT 10""")
def most_corrected(spark, d):
    return B.most_corrected(log(spark, d))


@query("style_usage", f"WITH {_LOG}, {_TT}, {_STYLE} SELECT tag, n FROM st")
def style_usage(spark, d):
    return B.style_usage(track_tags(spark, d), log(spark, d))


@query("should_suggest", f"WITH {_LOG}, {_TT}, {_STYLE} SELECT tag FROM st WHERE n >= 20")
def should_suggest(spark, d):
    return B.style_usage(track_tags(spark, d), log(spark, d)).where("n >= 20").select("tag")


@query("adjust_suggestions", f"""WITH {_LOG}, {_TT}, {_SUGG}, {_SUBS}, {_STYLE}, b AS (SELECT path, sg.tag AS was, coalesce(su.user_chose, sg.tag) AS tag,
    CASE WHEN su.user_chose IS NOT NULL THEN least(1.0, confidence * 1.2) ELSE least(1.0, confidence + least(0.1, coalesce(st.n, 0) * 0.01)) END AS confidence
    FROM sg LEFT JOIN su ON su.tag = sg.tag LEFT JOIN st ON st.tag = sg.tag), o AS (SELECT *, row_number() OVER (PARTITION BY path, tag ORDER BY was DESC) AS rn FROM b)
  SELECT path, tag, round(confidence, 6) AS confidence FROM o WHERE rn = 1 AND tag IN (SELECT tag FROM st WHERE n >= 2)""")
def adjust_suggestions(spark, d):
    usage = B.style_usage(track_tags(spark, d), log(spark, d))
    return B.adjust(suggestions(spark, d), B.substitutions(log(spark, d)), usage).select("path", "tag", F.round("confidence", 6).alias("confidence"))


@query("unused_tags", f"WITH {_TT} SELECT tag FROM tag_vocab WHERE tag NOT IN (SELECT tag FROM tt)")
def unused_tags(spark, d):
    return B.unused(table(spark, d, "tag_vocab"), B.tag_usage(track_tags(spark, d)))


@query("safety_overlap", f"WITH {_SUGG}, {_UT} SELECT path, count(*) AS n, array_to_string(list(tag ORDER BY tag), ', ') AS tags FROM ut JOIN sg USING (path, tag) GROUP BY path")
def safety_overlap(spark, d):
    return B.overlap(user_tags(spark, d), suggestions(spark, d))


@query("combined_tags", f"WITH {_SUGG}, {_UT} SELECT path, tag, min(source) AS source FROM (SELECT path, tag, 'user' AS source FROM ut UNION ALL SELECT path, tag, 'ai' FROM sg) GROUP BY path, tag")
def combined_tags(spark, d):
    return B.combined(user_tags(spark, d), suggestions(spark, d))


_ACCEPT = f"{_SUGG}, {_UT}, ac AS (SELECT path, tag, confidence FROM sg WHERE confidence >= 0.9)"


@query("accept_flow", f"""WITH {_ACCEPT}, n AS (SELECT path, tag FROM ut UNION SELECT path, tag FROM ac), r AS (SELECT path, tag, confidence FROM sg WHERE confidence < 0.9)
  SELECT 'user' AS store, path, tag, NULL::DOUBLE AS confidence FROM n UNION ALL SELECT 'ai', path, tag, confidence FROM r UNION ALL SELECT 'log', path, tag, confidence FROM ac""")
def accept_flow(spark, d):
    s = suggestions(spark, d)
    tags, rest, entries = B.accept(user_tags(spark, d), s, s.where("confidence >= 0.9"))
    part = lambda df, name, c: df.select(F.lit(name).alias("store"), "path", "tag", c.alias("confidence"))
    return part(tags, "user", F.lit(None).cast("double")).unionByName(part(rest, "ai", F.col("confidence"))).unionByName(part(entries, "log", F.col("confidence")))


@query("reject_flow", f"""WITH {_SUGG} SELECT 'ai' AS store, path, tag, confidence, NULL::VARCHAR AS reason FROM sg WHERE confidence >= 0.4 UNION ALL SELECT 'log', path, tag, confidence, 'unsure' FROM sg WHERE confidence < 0.4""")
def reject_flow(spark, d):
    s = suggestions(spark, d)
    rest, entries = B.reject(s, s.where("confidence < 0.4").select("path", "tag", F.lit("unsure").alias("reason")))
    return rest.select(F.lit("ai").alias("store"), "path", "tag", "confidence", F.lit(None).cast("string").alias("reason")).unionByName(entries.select(F.lit("log").alias("store"), "path", "tag", "confidence", "reason"))


@query("migrate", f"SELECT path, array_to_string(list_sort(list_distinct(flatten(list(l)))), '|') AS tags FROM (SELECT path, {sql.tags('mytags')} AS l FROM tracks) WHERE len(l) > 0 GROUP BY path")
def migrate(spark, d):
    old = tracks(spark, d).select("path", F.explode(T.clean_tags(F.col("mytags"))).alias("tag"))
    return B.migrate(old).select("path", F.array_join("tags", "|").alias("tags"))


_FIRST = f"f AS (SELECT path, {sql.tags('mytags')} AS l FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord DESC) AS rn FROM tracks) WHERE rn = 1 AND path IS NOT NULL)"


@query("bulk_set_tags", f"""WITH {_FIRST} SELECT path, array_to_string(CASE WHEN contains(path, '/forum/') THEN ['Reset', 'Lift'] ELSE l END, '|') AS tags FROM f WHERE NOT contains(path, '/radio/') AND (len(l) > 0 OR contains(path, '/forum/'))""")
def bulk_set_tags(spark, d):
    from cratewave.operators import catalog

    now = catalog.latest(tracks(spark, d).select("ord", "path", "mytags")).where("path is not null").select("path", T.clean_tags(F.col("mytags")).alias("tags"))
    changes = now.where(F.contains("path", F.lit("/forum/"))).select("path", F.array(F.lit("Reset"), F.lit("Lift")).alias("tags"))
    cleared = now.where(F.contains("path", F.lit("/radio/"))).select("path", F.array().cast("array<string>").alias("tags"))
    return B.set_tags(now.where(F.size("tags") > 0), changes.unionByName(cleared)).select("path", F.array_join("tags", "|").alias("tags"))


@query("log_by_day", """WITH l AS (SELECT strftime(logged_at, '%Y-%m-%d') AS day, action, round(confidence * 1000000000)::BIGINT AS c FROM correction_log WHERE logged_at IS NOT NULL), s AS (SELECT day, action, count(*) AS n, count(c)::HUGEINT AS k, sum(c)::HUGEINT AS s FROM l GROUP BY day, action)
  SELECT day, action, n, ((s + 500 * k) // (1000 * k))::BIGINT / 1000000.0::DOUBLE AS confidence FROM s""")
def log_by_day(spark, d):
    rows = table(spark, d, "correction_log").where("logged_at is not null")
    return rows.groupBy(F.date_format("logged_at", "yyyy-MM-dd").alias("day"), "action").agg(F.count("*").alias("n"), S.exact_mean(F.col("confidence")).alias("confidence"))
