"""Queries on outside lists, series of beats, scalars of tracks, and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewave.functions import audio as A
from cratewave.functions import vectors as V
from cratewave.operators import matching, timeseries
from cratewave.plans import register, sql
from cratewave.plans.library import tracks, vectors
from cratewave.session import table
from cratewave.sources import rekordbox

query, QUERIES, ORACLES = register()


# outside lists

_SPLIT = "list_filter(list_transform(string_split(replace({0}, ';', ','), ','), lambda t: trim(t)), lambda t: t <> '')"
# the shop's own rows, and bought copies of every tenth track as a shop writes them: other case, blanks, other delimiters
_SHOP = """sr AS (SELECT row_id, artist, title, tags, genre, subgenre FROM shop_rows UNION ALL
  SELECT 100000000 + ord, upper(artist), ' ' || title, coalesce(array_to_string(tags, '; '), ''), CASE WHEN ord % 20 = 0 THEN 'Bought' END, NULL FROM tracks WHERE ord % 10 = 0)"""
_MATCH = _SHOP + """, m AS (SELECT t.ord, s.* FROM sr s JOIN tracks t ON lower(trim(coalesce(s.artist, ''))) = lower(trim(coalesce(t.artist, ''))) AND lower(trim(coalesce(s.title, ''))) = lower(trim(coalesce(t.title, ''))))"""


def shop(spark, d):
    """Rows of `_SHOP`."""
    own = table(spark, d, "shop_rows").select("row_id", "artist", "title", "tags", "genre", "subgenre")
    bought = tracks(spark, d).where("ord % 10 = 0").select(
        (F.lit(100000000) + F.col("ord")).alias("row_id"), F.upper("artist").alias("artist"), F.concat(F.lit(" "), "title").alias("title"), F.coalesce(F.array_join("tags", "; "), F.lit("")).alias("tags"),
        F.when(F.col("ord") % 20 == 0, "Bought").alias("genre"), F.lit(None).cast("string").alias("subgenre"),
    )
    return own.unionByName(bought)


@query("bandcamp_merge", f"""WITH {_MATCH}, b AS (SELECT ord, arg_min(coalesce(tags, ''), row_id) AS first_tags, arg_max(genre, row_id) FILTER (WHERE coalesce(genre, '') <> '') AS g, arg_max(subgenre, row_id) FILTER (WHERE coalesce(subgenre, '') <> '') AS sg, count(*) AS rows FROM m GROUP BY ord)
  SELECT t.ord, array_to_string(coalesce(t.tags, list_sort(list_distinct({_SPLIT.format("b.first_tags")}))), '|') AS tags, coalesce(b.g, t.genre) AS genre, coalesce(b.sg, t.subgenre) AS subgenre, b.rows FROM tracks t JOIN b USING (ord)""")
def bandcamp_merge(spark, d):
    return matching.merge_shop(shop(spark, d), tracks(spark, d)).select("ord", F.array_join("tags", "|").alias("tags"), "genre", "subgenre", "rows")


@query("shop_tags", f"SELECT row_id, array_to_string({_SPLIT.format('tags')}, '|') AS tags, len({_SPLIT.format('tags')})::INTEGER AS n FROM shop_rows WHERE tags IS NOT NULL")
def shop_tags(spark, d):
    from cratewave.functions import text as T

    rows = table(spark, d, "shop_rows").where("tags is not null").select("row_id", T.split_tags(F.col("tags")).alias("t"))
    return rows.select("row_id", F.array_join("t", "|").alias("tags"), F.size("t").alias("n"))


@query("csv_mirror", f"""WITH {_SHOP}, s AS (SELECT lower(trim(coalesce(artist, ''))) AS a, lower(trim(coalesce(title, ''))) AS t, min(row_id) AS row_id FROM sr GROUP BY 1, 2)
  SELECT t.ord, min(s.row_id) AS first_row FROM tracks t JOIN s ON contains(lower(coalesce(t.artist, '')), s.a) AND contains(lower(coalesce(t.title, '')), s.t) GROUP BY t.ord""")
def csv_mirror(spark, d):
    return matching.mirror_playlist(shop(spark, d), tracks(spark, d))


# beats: the events of a user stand for the beats of a track

_GAPS = f"{sql.EPOCH_BEATS}, gp AS (SELECT *, t - lag(t) OVER (PARTITION BY path ORDER BY i) AS gap FROM beats)"
_SLIDE = f"{_GAPS}, sl AS (SELECT path, i, t, quantile_cont(gap, 0.5) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS m FROM gp)"


def beats(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").where("user_id is not null").withColumn("i", F.row_number().over(order) - 1)
    return rows.select(F.col("user_id").alias("path"), "i", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))


@query("beat_intervals", f"WITH {_GAPS} SELECT path, i, round(gap, 6) AS gap FROM gp")
def beat_intervals(spark, d):
    return timeseries.intervals(beats(spark, d)).select("path", F.col("i").cast("bigint").alias("i"), F.round("gap", 6).alias("gap"))


@query("beat_bpm", f"WITH {_GAPS} SELECT path, count(*) AS beats, round(CASE WHEN quantile_cont(gap, 0.5) > 0 THEN 60.0 / quantile_cont(gap, 0.5) ELSE 0 END, 6) AS bpm FROM gp GROUP BY path")
def beat_bpm(spark, d):
    return timeseries.tempo(beats(spark, d)).select("path", "beats", F.round("bpm", 6).alias("bpm"))


@query("sliding_bpm", f"WITH {_SLIDE} SELECT path, i, round(CASE WHEN m > 0 THEN 60.0 / m ELSE 0 END, 6) AS bpm FROM sl")
def sliding_bpm(spark, d):
    return timeseries.sliding_tempo(beats(spark, d), 4).select("path", F.col("i").cast("bigint").alias("i"), F.round("bpm", 6).alias("bpm"))


@query("tempo_segments_fixed", f"WITH {_GAPS} SELECT path, 1 AS segment, 0.0::DOUBLE AS start, round(CASE WHEN quantile_cont(gap, 0.5) > 0 THEN 60.0 / quantile_cont(gap, 0.5) ELSE 0 END, 6) AS bpm FROM gp GROUP BY path")
def tempo_segments_fixed(spark, d):
    return timeseries.segments(beats(spark, d)).withColumn("bpm", F.round("bpm", 6))


@query("tempo_segments_dynamic", f"""WITH RECURSIVE {_SLIDE}, lo AS (SELECT path, i, t, CASE WHEN m > 0 THEN 60.0 / m ELSE 0 END AS bpm FROM sl), n AS (SELECT path, max(i) AS last FROM beats GROUP BY path),
  f AS (SELECT path, CASE WHEN quantile_cont(gap, 0.5) > 0 THEN 60.0 / quantile_cont(gap, 0.5) ELSE 0 END AS bpm FROM gp WHERE i < 16 GROUP BY path),
  al AS (SELECT path, CASE WHEN quantile_cont(gap, 0.5) > 0 THEN 60.0 / quantile_cont(gap, 0.5) ELSE 0 END AS bpm FROM gp GROUP BY path),
  w AS (SELECT path, 15::BIGINT AS i, 0::BIGINT AS start, bpm AS seg, 1 AS segment, NULL::BIGINT AS e_start, NULL::DOUBLE AS e_bpm FROM f
    UNION ALL SELECT w.path, w.i + 1, CASE WHEN b THEN greatest(0, w.i + 1 - 16) ELSE w.start END, CASE WHEN b THEN x.bpm ELSE w.seg END, CASE WHEN b THEN w.segment + 1 ELSE w.segment END, CASE WHEN b THEN w.start END, CASE WHEN b THEN w.seg END
    FROM w JOIN (SELECT * FROM lo) x ON x.path = w.path AND x.i = w.i + 1, LATERAL (SELECT w.seg > 0 AND abs(x.bpm - w.seg) / w.seg * 100 > 20 AS b)),
  ends AS (SELECT path, segment - 1 AS segment, e_start AS start, e_bpm AS bpm FROM w WHERE e_start IS NOT NULL UNION ALL
    SELECT path, segment, start, seg FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i DESC) AS rn FROM w) WHERE rn = 1)
  SELECT e.path, CASE WHEN al.bpm <= 0 THEN 1 ELSE e.segment END AS segment, round(CASE WHEN al.bpm <= 0 THEN 0.0 ELSE b.t END, 6) AS start, round(CASE WHEN al.bpm <= 0 THEN 0.0 ELSE e.bpm END, 6) AS bpm
  FROM ends e JOIN beats b ON b.path = e.path AND b.i = e.start JOIN al ON al.path = e.path WHERE al.bpm > 0 OR e.segment = 1""")
def tempo_segments_dynamic(spark, d):
    return timeseries.segments(beats(spark, d), "dynamic", 20.0, 4).select("path", "segment", F.round("start", 6).alias("start"), F.round("bpm", 6).alias("bpm"))


@query("beat_confidence", """SELECT user_id AS path, round(greatest(0.0, least(1.0, coalesce(CASE WHEN max(value) > 0 THEN avg(value) FILTER (WHERE event_type = 'click') / max(value) END, 0.0))), 6) AS confidence FROM events GROUP BY user_id""")
def beat_confidence(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("value").alias("strength"), (F.col("event_type") == "click").alias("is_beat"))
    return timeseries.confidence(rows).select("path", F.round("confidence", 6).alias("confidence"))


_TRACKERS = "SELECT ord, bpm, samples AS confidence, duration % 3 AS beats, bpm * 2 AS bpm2, 1 - samples AS confidence2, duration % 2 AS beats2 FROM tracks"


@query("backend_fallback", f"""WITH r AS ({_TRACKERS}), c AS (SELECT *, coalesce(coalesce(confidence, 0) < 0.3 AND coalesce(beats2, 0) > 0 AND (coalesce(beats, 0) = 0 OR confidence2 > coalesce(confidence, 0)), false) AS s FROM r)
  SELECT ord, CASE WHEN s THEN 'second' ELSE 'first' END AS chosen, CASE WHEN s THEN bpm2 ELSE bpm END AS bpm_chosen, round(CASE WHEN s THEN confidence2 ELSE confidence END, 6) AS confidence_chosen FROM c""")
def backend_fallback(spark, d):
    r = tracks(spark, d).select("ord", "bpm", F.col("samples").alias("confidence"), (F.col("duration") % 3).alias("beats"), (F.col("bpm") * 2).alias("bpm2"), (1 - F.col("samples")).alias("confidence2"), (F.col("duration") % 2).alias("beats2"))
    return timeseries.with_fallback(r).select("ord", "chosen", "bpm_chosen", F.round("confidence_chosen", 6).alias("confidence_chosen"))


_SERIES = f"{sql.EPOCH_BEATS.replace('beats AS (SELECT', 'beats AS (SELECT value AS x,')}"


def series(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").where("user_id is not null").withColumn("i", F.row_number().over(order) - 1)
    return rows.select(F.col("user_id").alias("path"), "i", F.col("value").alias("x"), F.col("value").alias("strength"), F.col("i").cast("double").alias("t"))


@query("local_minima", f"""WITH {_SERIES}, r AS (SELECT path, i, x, lag(x) OVER w AS b, lead(x) OVER w AS a FROM beats WINDOW w AS (PARTITION BY path ORDER BY i)), l AS (SELECT path, quantile_cont(x, 0.4) AS lim FROM beats GROUP BY path),
  m AS (SELECT r.path, i, x, row_number() OVER (PARTITION BY r.path ORDER BY x, i) AS rank FROM r JOIN l ON l.path = r.path WHERE x < lim AND coalesce(x < b, true) AND coalesce(x < a, true)) SELECT path, rank, i, x FROM m WHERE rank <= 2""")
def local_minima(spark, d):
    return timeseries.minima(series(spark, d)).withColumn("i", F.col("i").cast("bigint"))


@query("drop_detection", f"""WITH {_SERIES} SELECT path, coalesce(arg_max(i, (x, -i)) FILTER (WHERE i > 15), arg_max(i, (x, -i)))::DOUBLE AS t FROM beats GROUP BY path""")
def drop_detection(spark, d):
    return timeseries.drop_time(series(spark, d))


@query("first_crossing", f"WITH {_SERIES} SELECT path, coalesce(min(i) FILTER (WHERE x > 100), min(i))::DOUBLE AS t FROM beats GROUP BY path")
def first_crossing(spark, d):
    return timeseries.first_crossing(series(spark, d), 100.0)


# scalars

_CUE = """c AS (SELECT ord, kick, dr, bpm, CASE WHEN bpm >= 122 THEN 16 * 240.0 / bpm ELSE 8 * 240.0 / bpm END AS l, CASE WHEN bpm >= 122 THEN 8 * 240.0 / bpm ELSE 4 * 240.0 / bpm END AS h FROM (SELECT ord, samples * 10 AS kick, 15 + samples * 60 AS dr, bpm FROM tracks WHERE bpm > 0)),
  c2 AS (SELECT *, greatest(0.0, dr - 0.1) AS ce, greatest(0.0, greatest(0.0, dr - 0.1) - l) AS cs, greatest(0.0, kick + 480.0 / bpm) AS a FROM c), c3 AS (SELECT *, a + l AS ae FROM c2),
  c4 AS (SELECT *, greatest(0.0, (CASE WHEN cs > ae THEN ae + (cs - ae) / 2 ELSE ae + 8 * 240.0 / bpm END) - h) AS bs FROM c3)"""


@query("cue_proposal", f"""WITH {_CUE}, r AS (SELECT ord, 'A' AS name, 0 AS type, a AS s, ae AS e FROM c4 UNION ALL SELECT ord, 'B', 0, bs, bs + l FROM c4 UNION ALL SELECT ord, 'C', 0, cs, ce FROM c4 UNION ALL SELECT ord, 'D', 0, dr, dr FROM c4
  UNION ALL SELECT ord, 'Drop (Mem)', 1, dr, dr FROM c4 UNION ALL SELECT ord, 'Mix-out', 1, dr + 32 * 240.0 / bpm, dr + 32 * 240.0 / bpm FROM c4) SELECT ord, name, type, -1 AS num, round(s, 6) AS "start", round(e, 6) AS "end" FROM r""")
def cue_proposal(spark, d):
    t = tracks(spark, d).where("bpm > 0").select("ord", F.explode(A.cues(F.col("samples") * 10, 15 + F.col("samples") * 60, F.col("bpm"))).alias("c"))
    return t.select("ord", "c.name", "c.type", "c.num", F.round("c.start", 6).alias("start"), F.round("c.end", 6).alias("end"))


@query("default_windows", """WITH t AS (SELECT ord, (duration - 60)::DOUBLE AS du, samples * 4 AS ns FROM tracks WHERE duration IS NOT NULL AND samples IS NOT NULL), a AS (SELECT *, CASE WHEN du >= 140 THEN 60.0 ELSE 40.0 END AS core FROM t),
  b AS (SELECT *, greatest(0.0, least(du / 2 - core / 2, du - core)) AS bs FROM a), c AS (SELECT *, greatest(0.0, least(bs + core, du)) AS be, greatest(du - 5, 0.0) AS ce FROM b), k AS (SELECT *, greatest(ce - 10, be + 5) AS cs FROM c),
  w AS (SELECT ord, du, 1 AS n, greatest(ns, 0.0) AS s, least(greatest(0.0, least(ns + 10, du)), du) AS e FROM k WHERE du >= 80 UNION ALL SELECT ord, du, 2, greatest(bs, 0.0), least(be, du) FROM k WHERE du >= 80 UNION ALL SELECT ord, du, 3, greatest(cs, 0.0), least(ce, du) FROM k WHERE du >= 80),
  r AS (SELECT ord, n, s, e FROM w WHERE e - s > 1 AND e > 0 AND s < du UNION ALL SELECT ord, 1, 0.0, du FROM k WHERE du > 0 AND du < 80 UNION ALL SELECT ord, 1, 0.0, 10.0 FROM k WHERE du <= 0)
  SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY n))::INTEGER AS n, round(s, 6) AS "start", round(e, 6) AS "end" FROM r""")
def default_windows(spark, d):
    t = tracks(spark, d).where("duration is not null and samples is not null")
    w = t.select("ord", F.posexplode(A.windows((F.col("duration") - 60).cast("double"), F.col("samples") * 4)).alias("p", "w"))
    return w.select("ord", (F.col("p") + 1).alias("n"), F.round("w.start", 6).alias("start"), F.round("w.end", 6).alias("end"))


def _key_sql() -> str:
    rows = ", ".join(f"({o}, '{c}', '{n}', [{', '.join(map(str, p))}]::DOUBLE[])" for o, c, n, p in A.key_profiles())
    return f"""WITH {sql.VECTORS}, k(o, camelot, name, p) AS (VALUES {rows}), c AS (SELECT ord, list_transform(v[1:12], lambda x: abs(x)) AS c FROM v),
      s AS (SELECT ord, o, camelot, name, round({sql.dot('c', 'p')} / sqrt({sql.dot('c', 'c')}), 9) AS score FROM c, k WHERE {sql.dot('c', 'c')} > 0)
      SELECT ord, camelot, name FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, o) AS rn FROM s) WHERE rn = 1"""


@query("key_estimate", _key_sql())
def key_estimate(spark, d):
    chroma = F.transform(F.slice("v", 1, 12), lambda x: F.abs(x))
    return vectors(spark, d).select("ord", A.best_key(chroma).alias("k")).where("k is not null").select("ord", "k.camelot", "k.name")


@query("replaygain", "SELECT ord, round(-11.0 - (samples * -20 - 3), 6) AS gain, round(16 * 240.0 / bpm, 6) AS bars16 FROM tracks WHERE bpm > 0")
def replaygain(spark, d):
    return tracks(spark, d).where("bpm > 0").select("ord", F.round(A.replay_gain(F.col("samples") * -20 - 3), 6).alias("gain"), F.round(A.bars(16, F.col("bpm")), 6).alias("bars16"))


@query("fix_length", f"WITH {sql.VECTORS} SELECT ord, len(w)::INTEGER AS n, round(list_sum(w), 6) AS total FROM (SELECT ord, list_resize(v, 256, 0.0::DOUBLE) AS w FROM v UNION ALL SELECT ord, v[1:100] FROM v)")
def fix_length(spark, d):
    v = vectors(spark, d)
    both = v.select("ord", V.fix_length(F.col("v"), 256).alias("w")).unionByName(v.select("ord", V.fix_length(F.col("v"), 100).alias("w")))
    return both.select("ord", F.size("w").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# exports

@query("xml_tracks", f"""SELECT row_number() OVER (ORDER BY ord) AS track_id, ord, coalesce(title, '') AS name, coalesce(artist, '') AS artist, genre, camelot AS tonality, bpm AS average_bpm,
  'file://localhost' || replace(url_encode(path), '%2F', '/') AS location, array_to_string(list_sort(list_distinct({sql.tags('mytags')})), '|') AS my_tags FROM tracks""")
def xml_tracks(spark, d):
    return rekordbox.export_rows(tracks(spark, d)).select("track_id", "ord", "name", "artist", "genre", "tonality", "average_bpm", "location", F.array_join("my_tags", "|").alias("my_tags"))


@query("xml_fragments", None)
def xml_fragments(spark, d):
    return rekordbox.fragments(rekordbox.export_rows(tracks(spark, d)))
