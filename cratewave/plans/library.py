"""Queries on the catalog itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewave.functions import harmony as H
from cratewave.functions import text as T
from cratewave.operators import catalog, dedupe, knn
from cratewave.plans import register, sql
from cratewave.session import table

query, QUERIES, ORACLES = register()

FILE_RULES = [(r"(?i)\.aiff?$", "lossless/aiff"), (r"(?i)\.(wav|flac)$", "lossless"), (r"(?i)\.mp3$", "lossy"), (r"(?i)^t0+\d?5", "fives")]
MODE_RULES = [("/CRATES/shop_b/d1", "stems"), ("/crates/forum/", "full"), ("/crates/shop_b", "baseline+")]
TRACK = "tracks"


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TRACK)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return knn.current_vectors(table(spark, d, "track_vectors"))


@query("library_table", f"""WITH {sql.VECTORS} SELECT t.ord, coalesce(artist, '') AS artist, CASE WHEN coalesce(title, '') <> '' THEN title ELSE regexp_extract(path, '[^\\\\/]*$') END AS title,
  CASE WHEN coalesce(bpm, 0) <> 0 THEN round_even(bpm, 0)::INTEGER END AS bpm_shown, CASE WHEN v.ord IS NOT NULL THEN 'Yes' ELSE 'No' END AS embedded,
  CASE WHEN coalesce(bpm, 0) <> 0 AND coalesce(camelot, '') <> '' THEN 'Yes' ELSE 'No' END AS analysed,
  coalesce(array_to_string(CASE WHEN len({sql.tags("mytags")}) > 0 THEN {sql.tags("mytags")} ELSE {sql.tags("tags")} END, ', '), '') AS tags_shown FROM tracks t LEFT JOIN v ON v.ord = t.ord""")
def library_table(spark, d):
    return catalog.library_table(tracks(spark, d), vectors(spark, d))


@query("library_counts", f"""WITH {sql.VECTORS} SELECT count(*) AS total, count(v.ord) AS embedded,
  count(*) FILTER (WHERE coalesce(bpm, 0) <> 0 AND coalesce(camelot, '') <> '') AS analysed FROM tracks t LEFT JOIN v ON v.ord = t.ord""")
def library_counts(spark, d):
    return catalog.counts(tracks(spark, d), vectors(spark, d))


@query("library_search", f"""SELECT ord, artist, title FROM tracks WHERE contains(lower(coalesce(artist, '')), 'night') OR contains(lower(coalesce(title, '')), 'night')
  OR contains(lower(coalesce(array_to_string({sql.tags("mytags")}, ' '), '')), 'night')""")
def library_search(spark, d):
    return catalog.search(tracks(spark, d), "  Night ").select("ord", "artist", "title")


@query("seed_search", """SELECT ord, path, CASE WHEN coalesce(artist, '') <> '' THEN artist || ' - ' || coalesce(title, '') ELSE coalesce(title, '') END AS label FROM tracks
  WHERE contains(lower(CASE WHEN coalesce(artist, '') <> '' THEN artist || ' - ' || coalesce(title, '') ELSE coalesce(title, '') END), 'an') OR contains(lower(path), 'an') ORDER BY ord LIMIT 100""")
def seed_search(spark, d):
    return catalog.seed_options(tracks(spark, d), "an")


@query("catalog_latest", "SELECT ord, path, artist, title, bpm FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord DESC) AS rn FROM tracks) WHERE rn = 1")
def catalog_latest(spark, d):
    return catalog.latest(tracks(spark, d).select("ord", "path", "artist", "title", "bpm"))


_KEYS = [f"{n}{x}" for n in range(1, 13) for x in "AB"] + ["0A", "13B", " 8a ", "x", ""]
_KEY_ROWS = ", ".join(f"('{k}')" for k in _KEYS)


@query("camelot_matrix", f"""WITH k(s) AS (VALUES {_KEY_ROWS}), p AS (SELECT a.s AS seed, b.s AS cand FROM k a, k b)
  SELECT seed, cand, {sql.relation("seed", "cand")} AS relation, {sql.compatible("seed", "cand")} AS ok, {sql.relation_score("seed", "cand")}::DOUBLE AS score FROM p""")
def camelot_matrix(spark, d):
    keys = F.array(*[F.lit(k) for k in _KEYS])
    p = spark.range(1).select(F.explode(keys).alias("seed")).select("seed", F.explode(keys).alias("cand"))
    s, c = F.col("seed"), F.col("cand")
    return p.select("seed", "cand", H.relation(s, c).alias("relation"), H.compatible(s, c).alias("ok"), H.relation_score(s, c).alias("score"))


@query("key_parse", f"SELECT camelot, count(*) AS n, {sql.number('camelot')} AS number, {sql.letter('camelot')} AS letter FROM tracks GROUP BY camelot")
def key_parse(spark, d):
    k = F.col("camelot")
    return tracks(spark, d).groupBy("camelot").agg(F.count("*").alias("n")).select("camelot", "n", H.key_number(k).alias("number"), H.key_letter(k).alias("letter"))


_SEEDS = [0.0, 87.5, 120.0, 128.0, 174.0]


@query("tempo_match_pairs", f"""SELECT ord, seed, bpm, {sql.tempo("seed", "bpm")} AS ok, CASE WHEN coalesce(seed, 0) = 0 OR coalesce(bpm, 0) = 0 THEN '' WHEN bpm / seed BETWEEN 1.94 AND 2.06 THEN '2x'
  WHEN bpm / seed BETWEEN 0.47 AND 0.53 THEN '1/2x' ELSE '~' END AS note, round({sql.tempo_score("seed", "bpm", 6.0)}, 6) AS score
  FROM (SELECT ord, bpm, unnest([{", ".join(map(str, _SEEDS))}]::DOUBLE[]) AS seed FROM tracks)""")
def tempo_match_pairs(spark, d):
    p = tracks(spark, d).select("ord", "bpm", F.explode(F.array(*[F.lit(s) for s in _SEEDS])).alias("seed"))
    s, c = F.col("seed"), F.col("bpm")
    return p.select("ord", "seed", "bpm", H.tempo_matches(s, c).alias("ok"), H.tempo_note(s, c).alias("note"), F.round(H.tempo_score(s, c, 6.0), 6).alias("score"))


def _mode_sql() -> str:
    cases = " ".join(f"WHEN starts_with(lower(path), '{p.rstrip('/').lower()}') THEN '{m}'" for p, m in MODE_RULES)
    return f"SELECT ord, path, CASE {cases} ELSE 'baseline' END AS mode FROM tracks"


@query("folder_mode", _mode_sql())
def folder_mode(spark, d):
    return catalog.folder_mode(tracks(spark, d), MODE_RULES)


@query("work_selection", "SELECT ord, path FROM tracks WHERE coalesce(bpm, 0) = 0 OR coalesce(camelot, '') = ''")
def work_selection(spark, d):
    return catalog.needs_analysis(tracks(spark, d)).select("ord", "path")


@query("work_selection_vectors", f"WITH {sql.VECTORS} SELECT ord, path FROM tracks WHERE ord NOT IN (SELECT ord FROM v)")
def work_selection_vectors(spark, d):
    return tracks(spark, d).join(vectors(spark, d).select("ord"), "ord", "left_anti").select("ord", "path")


@query("workspace_classify", "SELECT path, CASE WHEN regexp_matches(b, '(?i)\\.aiff?$') THEN 'lossless/aiff' WHEN regexp_matches(b, '(?i)\\.(wav|flac)$') THEN 'lossless' WHEN regexp_matches(b, '(?i)\\.mp3$') THEN 'lossy'"
       " WHEN regexp_matches(b, '(?i)^t0+\\d?5') THEN 'fives' END AS dest FROM (SELECT path, regexp_extract(path, '[^\\\\/]*$') AS b FROM tracks)")
def workspace_classify(spark, d):
    return catalog.classify_files(tracks(spark, d), FILE_RULES)


@query("path_parts", """SELECT ord, b AS basename, regexp_replace(b, '\\.[^.]*$', '') AS stem, lower(regexp_extract(b, '\\.([^.]+)$', 1)) AS suffix,
  CASE WHEN lower(regexp_extract(b, '\\.([^.]+)$', 1)) IN ('flac', 'wav', 'aiff', 'aif') THEN 1 ELSE 0 END AS lossless FROM (SELECT ord, regexp_extract(path, '[^\\\\/]*$') AS b FROM tracks)""")
def path_parts(spark, d):
    p = F.col("path")
    return tracks(spark, d).select("ord", T.basename(p).alias("basename"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"), T.is_lossless(p).alias("lossless"))


@query("label_parts", """SELECT row_id, CASE WHEN contains(s, ' - ') THEN string_split(s, ' - ')[1] ELSE '' END AS first_artist, CASE WHEN contains(s, ' - ') THEN substr(s, strpos(s, ' - ') + 3) ELSE s END AS rest_title,
  string_split(s, ' - ')[-1] AS last_title FROM (SELECT row_id, coalesce(artist, '') || ' - ' || coalesce(title, '') AS s FROM shop_rows)""")
def label_parts(spark, d):
    s = F.col("s")
    rows = table(spark, d, "shop_rows").select("row_id", T.label(F.col("artist"), F.col("title")).alias("s"))
    cut = F.locate(" - ", s)
    return rows.select("row_id", F.when(cut > 0, F.element_at(F.split(s, " - "), 1)).otherwise("").alias("first_artist"),
                       F.when(cut > 0, F.substring(s, cut + 3, F.length(s))).otherwise(s).alias("rest_title"), F.element_at(F.split(s, " - "), -1).alias("last_title"))


_RULES = {"tag": "After Hours", "rating_min": 2, "since": "2023-06-01", "until": "2025-06-30"}


@query("playlist_rules", f"""SELECT ord, path FROM (SELECT *, TRY_CAST(CASE WHEN regexp_matches(substr(added, 1, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN substr(added, 1, 10) END AS DATE) AS day FROM tracks)
  WHERE list_contains({sql.tags("mytags")}, 'After Hours') AND coalesce(rating, 0) >= 2 AND coalesce(day >= DATE '2023-06-01', true) AND coalesce(day <= DATE '2025-06-30', true)""")
def playlist_rules(spark, d):
    return catalog.playlist(tracks(spark, d), **_RULES).select("ord", "path")


@query("playlist_dates", """SELECT ord, added FROM (SELECT *, TRY_CAST(CASE WHEN regexp_matches(substr(added, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN substr(added, 1, 10) END AS DATE) AS day FROM tracks)
  WHERE coalesce(day >= DATE '2024-03-01', true)""")
def playlist_dates(spark, d):
    return catalog.playlist(tracks(spark, d), since="2024-03-01").select("ord", "added")


@query("presets_upsert", "SELECT * FROM (VALUES ('Closing', 'closing.xml', 'Closing', 4), ('Peak', 'peak2.xml', 'Peak Hour', 3), ('Warmup', 'warmup.xml', 'Warm-up', 3)) t(name, output, mytag, rating_min)")
def presets_upsert(spark, d):
    schema = "name string, output string, mytag string, rating_min int"
    old = spark.createDataFrame([("Warmup", "warmup.xml", "Warm-up", 3), ("Peak", "peak.xml", "Peak Hour", 5)], schema)
    return catalog.upsert(old, spark.createDataFrame([("Peak", "peak2.xml", "Peak Hour", 3), ("Closing", "closing.xml", "Closing", 4)], schema), "name")


@query("analysis_merge", """SELECT t.ord, coalesce(r.bpm, t.bpm) AS bpm, coalesce(r.camelot, t.camelot) AS camelot, coalesce(t.artist, r.artist) AS artist, coalesce(t.title, r.title) AS title, coalesce(t.samples, r.samples) AS samples
  FROM tracks t LEFT JOIN (SELECT path, max(artist) AS artist, max(title) AS title, max(bpm) + 1 AS bpm, max(camelot) AS camelot, max(samples) AS samples FROM tracks WHERE bpm > 150 GROUP BY path) r ON r.path = t.path""")
def analysis_merge(spark, d):
    t = tracks(spark, d)
    results = t.where("bpm > 150").groupBy("path").agg(F.max("artist").alias("artist"), F.max("title").alias("title"), (F.max("bpm") + 1).alias("bpm"), F.max("camelot").alias("camelot"), F.max("samples").alias("samples"))
    return catalog.merge_analysis(t, results).select("ord", "bpm", "camelot", "artist", "title", "samples")


@query("tag_registry", f"SELECT tag, row_number() OVER (ORDER BY tag) AS tag_id FROM (SELECT DISTINCT tag FROM ({sql.exploded()}))")
def tag_registry(spark, d):
    return catalog.tag_registry(tracks(spark, d))


@query("location_uri", """SELECT ord, 'file://localhost' || CASE WHEN starts_with(u, '/') THEN '' ELSE '/' END || u AS uri, p AS back FROM
  (SELECT ord, p, replace(url_encode(p), '%2F', '/') AS u FROM (SELECT ord, path || ' ' || coalesce(title, '') || '+~' AS p FROM tracks))""")
def location_uri(spark, d):
    p = F.concat("path", F.lit(" "), F.coalesce("title", F.lit("")), F.lit("+~"))
    return tracks(spark, d).select("ord", T.location_uri(p).alias("uri"), T.location_path(T.location_uri(p)).alias("back"))


_BUCKET = "lower(trim(coalesce(artist, ''))) AS a, lower(trim(coalesce(title, ''))) AS t, coalesce(duration, 0) AS du"


@query("dup_fuzzy", f"""WITH k AS (SELECT ord, path, bitrate, {_BUCKET}, CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('flac', 'wav', 'aiff', 'aif') THEN 1 ELSE 0 END AS lossless FROM tracks),
  r AS (SELECT *, first_value(ord) OVER w AS keep, row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY a, t, du ORDER BY lossless DESC, coalesce(bitrate, 0) DESC, ord)) SELECT keep, ord AS lose FROM r WHERE rn > 1""")
def dup_fuzzy(spark, d):
    return dedupe.keep_best(dedupe.names_key(tracks(spark, d).withColumn("lossless", T.is_lossless(F.col("path")))))


@query("dup_fuzzy_groups", f"SELECT min(ord) AS first, count(*) AS n FROM (SELECT ord, {_BUCKET} FROM tracks) GROUP BY a, t, du HAVING count(*) > 1")
def dup_fuzzy_groups(spark, d):
    return dedupe.groups(dedupe.names_key(tracks(spark, d)))


@query("dup_exact", """WITH r AS (SELECT doc_id, first_value(doc_id) OVER w AS keep, row_number() OVER w AS rn FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY n_chars DESC, doc_id))
  SELECT keep, doc_id AS lose FROM r WHERE rn > 1""")
def dup_exact(spark, d):
    docs = dedupe.content_key(table(spark, d, "documents"), "text").withColumn("lossless", F.lit(0))
    return dedupe.keep_best(docs, bitrate="n_chars", order="doc_id")


@query("dup_stage_plan", f"""WITH k AS (SELECT ord, path, bitrate, {_BUCKET}, CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('flac', 'wav', 'aiff', 'aif') THEN 1 ELSE 0 END AS lossless FROM tracks),
  r AS (SELECT *, row_number() OVER (PARTITION BY a, t, du ORDER BY lossless DESC, coalesce(bitrate, 0) DESC, ord) AS rn FROM k), l AS (SELECT ord, path, regexp_extract(path, '[^\\\\/]*$') AS b FROM r WHERE rn > 1),
  n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY ord) - 1 AS nth FROM l)
  SELECT ord, path, '/staged/' || CASE WHEN nth = 0 THEN b ELSE regexp_replace(b, '\\.[^.]*$', '') || '_' || nth::VARCHAR || regexp_extract(b, '(\\.[^.]*)$', 1) END AS target FROM n""")
def dup_stage_plan(spark, d):
    t = tracks(spark, d)
    losers = dup_fuzzy(spark, d).select(F.col("lose").alias("ord"))
    return dedupe.stage_plan(t.select("ord", "path").join(losers, "ord"), "/staged/")


@query("cdj_warnings", "SELECT ord, path, 'Sample rate ' || r::VARCHAR || 'Hz may be unsupported' AS warning FROM (SELECT ord, path, 48000 * (1 + ord % 4) AS r FROM tracks) WHERE r > 96000")
def cdj_warnings(spark, d):
    return dedupe.player_warnings(tracks(spark, d).withColumn("sample_rate", F.lit(48000) * (1 + F.col("ord") % 4)))
