"""Queries that rank tracks around seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewave.functions import vectors as V
from cratewave.operators import knn, rank
from cratewave.plans import register, sql
from cratewave.plans.library import tracks, vectors
from cratewave.session import table

query, QUERIES, ORACLES = register()

SEED = "forum/d1"
_SEED_SQL = """s AS (SELECT * FROM idx WHERE contains(lower(path), 'forum/d1') OR contains(lower(coalesce(artist, '') || ' - ' || coalesce(title, '')), 'forum/d1') ORDER BY label LIMIT 1)"""


def indexed(spark, d):
    """(ord, label, v) of the index. Rankings use labels only to order, and labels follow `ord`, so positions need not be
    counted here. Of the catalog only `ord` is read; its other columns are fetched for the rows of a pool."""
    return vectors(spark, d).select("ord", "v").join(tracks(spark, d).select("ord"), "ord", "left_semi").withColumn("label", F.col("ord"))


def seeded(spark, d):
    """(index rows, seed, catalog): the seed is looked for in the catalog, and vectors of the tracks found only."""
    found = rank.named(tracks(spark, d), SEED)
    own = knn.current_vectors(table(spark, d, "track_vectors").join(found.select("ord"), "ord", "left_semi")).select("ord", "v")
    seed = found.join(own, "ord").withColumn("label", F.col("ord")).orderBy("label").limit(1).first()
    return indexed(spark, d), seed, tracks(spark, d)


def _pool(k: int, columns: str = "") -> str:
    return f"""WITH {sql.INDEX}, {_SEED_SQL}, pool AS (SELECT * FROM (SELECT i.*, s.ord AS s_ord, s.camelot AS s_camelot, s.bpm AS s_bpm, s.tags AS s_tags, s.mytags AS s_mytags, s.v AS s_v,
      {sql.dist("i.v", "s.v")} AS dist FROM idx i, s ORDER BY dist, label LIMIT {k}) WHERE ord <> s_ord)"""


def _recommend(k: int, top: int, camelot: bool, score: str, order: str) -> str:
    where = [sql.tempo("s_bpm", "bpm")] + ([sql.compatible("s_camelot", "camelot")] if camelot else [])
    return f"""{_pool(k)}, f AS (SELECT *, {score} AS score, {sql.relation("s_camelot", "camelot")} AS relation FROM pool WHERE {" AND ".join(where)})
      SELECT row_number() OVER (ORDER BY {order}) AS rank, ord, relation, round(dist, 6) AS dist, round(score, 6) AS score FROM f ORDER BY {order} LIMIT {top}"""


@query("recommend", _recommend(75, 25, True, "0.0::DOUBLE", "dist, label"))
def recommend(spark, d):
    return rank.recommend(*seeded(spark, d))


@query("recommend_no_key", _recommend(75, 25, False, "0.0::DOUBLE", "dist, label"))
def recommend_no_key(spark, d):
    return rank.recommend(*seeded(spark, d), camelot=False)


_CLI = f"0.7 * (1 - dist) + 0.3 * coalesce(samples, 0) + 0.2 * {sql.contour(sql.BASS, sql.BASS.replace('v[', 's_v['), 64, True)} + 0.1 * {sql.contour(sql.RHYTHM, sql.RHYTHM.replace('v[', 's_v['), 64, False)}"


@query("recommend_weighted", _recommend(75, 25, True, _CLI, "score DESC, dist, label"))
def recommend_weighted(spark, d):
    return rank.recommend(*seeded(spark, d), weights={"ann": 0.7, "samples": 0.3, "bass": 0.2, "rhythm": 0.1})


@query("recommend_sequence", f"""WITH {sql.INDEX}, s AS (SELECT * FROM idx WHERE contains(path, '/radio/') ORDER BY label LIMIT 3),
  e AS (SELECT unnest(v) AS x, unnest(range(128)) AS p FROM s), m AS (SELECT list(x ORDER BY p) AS v FROM (SELECT p, avg(x) AS x FROM e GROUP BY p)),
  pool AS (SELECT i.*, {sql.dist("i.v", "m.v")} AS dist FROM idx i, m ORDER BY dist, label LIMIT 100)
  SELECT row_number() OVER (ORDER BY dist, label) AS rank, ord, round(dist, 6) AS dist FROM pool WHERE ord NOT IN (SELECT ord FROM s) ORDER BY dist, label LIMIT 25""")
def recommend_sequence(spark, d):
    found = tracks(spark, d).where(F.contains("path", F.lit("/radio/"))).select("ord")
    own = knn.current_vectors(table(spark, d, "track_vectors").join(found, "ord", "left_semi"))
    return rank.sequence(indexed(spark, d), own.select("ord", "v").orderBy("ord").limit(3))


def _discover(spec: rank.RankingSpec, top: int) -> str:
    w = {k: spec.weights.get(k, 0.0) for k in rank.WEIGHTS}
    total = sum(w.values()) if sum(w.values()) > 0 else 1.0
    both = f"list_distinct(list_concat({sql.tags('tags')}, {sql.tags('mytags')}))"
    prefer = "[" + ", ".join(f"'{t}'" for t in spec.prefer_tags) + "]::VARCHAR[]"
    own = f"list_distinct(list_concat(list_concat({sql.tags('s_tags')}, {sql.tags('s_mytags')}), {prefer}))"
    key = sql.relation_score("s_camelot", "camelot")
    bucket = f"(CASE WHEN {key} >= 0.99 THEN 'same' WHEN {key} >= 0.79 THEN 'relative' WHEN {key} >= 0.69 THEN 'neighbor' ELSE {sql.relation('s_camelot', 'camelot')} END)"
    known = "coalesce(s_bpm > 0 AND bpm > 0, false)"
    where = [sql.tempo("s_bpm", "bpm", spec.tempo_pct)]
    if spec.bpm_max_diff > 0:
        where.append(f"(NOT {known} OR abs(s_bpm - bpm) <= {spec.bpm_max_diff})")
    for t in spec.require_tags:
        where.append(f"list_contains({both}, '{t}')")
    if spec.allowed_relations:
        where.append(f"{bucket} IN ({', '.join(repr(r) for r in spec.allowed_relations)})")
    elif spec.camelot:
        where.append(sql.compatible("s_camelot", "camelot"))
    jaccard = f"(CASE WHEN len({own}) = 0 OR len({both}) = 0 THEN 0.0 ELSE len(list_intersect({own}, {both}))::DOUBLE / len(list_distinct(list_concat({own}, {both}))) END)"
    score = f"({w['ann']} * (1 - dist) + {w['samples']} * coalesce(samples, 0) + {w['bass']} * {sql.contour(sql.BASS, sql.BASS.replace('v[', 's_v['), 64, True)}" \
        f" + {w['rhythm']} * {sql.contour(sql.RHYTHM, sql.RHYTHM.replace('v[', 's_v['), 64, False)} + CASE WHEN {known} THEN {w['bpm']} * {sql.tempo_score('s_bpm', 'bpm', spec.bpm_max_diff or spec.tempo_pct)} ELSE 0.0 END" \
        f" + {w['key']} * {key} + {w['tags']} * {jaccard}) / {total}"
    return f"""{_pool(4 * top)}, f AS (SELECT *, round({score}, 9) AS score, {bucket} AS relation FROM pool WHERE {" AND ".join(where)})
      SELECT row_number() OVER (ORDER BY score DESC, label) AS rank, ord, relation, round(dist, 6) AS dist, round(score, 6) AS score FROM f ORDER BY score DESC, label LIMIT {top}"""


def _preset(name: str, weights: tuple[float, ...]) -> None:
    spec = rank.RankingSpec(dict(zip(rank.WEIGHTS, weights)))

    @query(f"discover_{name}", _discover(spec, 50))
    def discover(spark, d):
        rows, seed, info = seeded(spark, d)
        return rank.discover(rows, seed, spec, info)


for _name, _weights in rank.PRESETS.items():
    _preset(_name, _weights)

_FILTERS = rank.RankingSpec({"ann": 0.5, "key": 0.2, "bpm": 0.2, "tags": 0.3}, tempo_pct=12.0, bpm_max_diff=25.0, allowed_relations=("same", "relative", "neighbor", "-"), prefer_tags=("Lift", "dreamy"))


@query("discover_filters", _discover(_FILTERS, 50))
def discover_filters(spark, d):
    rows, seed, info = seeded(spark, d)
    return rank.discover(rows, seed, _FILTERS, info)


_REQUIRED = rank.RankingSpec({"ann": 1.0, "tags": 0.5}, camelot=False, require_tags=("Opener",), tempo_pct=20.0)


@query("discover_required", _discover(_REQUIRED, 50))
def discover_required(spark, d):
    rows, seed, info = seeded(spark, d)
    return rank.discover(rows, seed, _REQUIRED, info)


_ALL = f"""a AS (SELECT q.ord AS q, i.ord, {sql.dist("q.v", "i.v")} AS dist FROM v q, v i WHERE q.ord % 20 = 0 AND q.ord <> i.ord),
  pool AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), ord) AS rank FROM a)"""


@query("knn_all_topk", f"WITH {sql.VECTORS}, {_ALL} SELECT q, rank, ord, round(dist, 6) AS dist FROM pool WHERE rank <= 10")
def knn_all_topk(spark, d):
    rows = vectors(spark, d).select("ord", "v")
    return knn.nearest_for_all(rows.where("ord % 20 = 0"), rows, 10).select("q", "rank", "ord", F.round("dist", 6).alias("dist"))


@query("recommend_all", f"""WITH {sql.VECTORS}, {_ALL}, f AS (SELECT p.q, p.ord, p.dist FROM pool p JOIN tracks t ON t.ord = p.ord JOIN tracks s ON s.ord = p.q
  WHERE p.rank <= 60 AND {sql.compatible("s.camelot", "t.camelot")} AND {sql.tempo("s.bpm", "t.bpm")}),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), ord) AS rank FROM f) SELECT q, rank, ord, round(dist, 6) AS dist FROM r WHERE rank <= 10""")
def recommend_all(spark, d):
    rows = vectors(spark, d).select("ord", "v")
    return rank.recommend_for_all(rows.where("ord % 20 = 0"), rows, tracks(spark, d))


@query("index_build", f"WITH {sql.INDEX} SELECT label, ord, path FROM idx")
def index_build(spark, d):
    return knn.index(table(spark, d, "track_vectors"), tracks(spark, d)).select("label", "ord", "path")


@query("index_incremental", f"""WITH {sql.INDEX}, o AS (SELECT row_number() OVER (ORDER BY p.ord) - 1 AS label, path FROM (SELECT min(ord) AS ord, path FROM idx WHERE ord % 3 <> 0 GROUP BY path) p),
  n AS (SELECT min(ord) AS ord, path FROM idx WHERE path NOT IN (SELECT path FROM o) GROUP BY path)
  SELECT label, path FROM o UNION ALL SELECT row_number() OVER (ORDER BY ord) - 1 + (SELECT count(*) FROM o) AS label, path FROM n""")
def index_incremental(spark, d):
    rows = vectors(spark, d).join(tracks(spark, d).select("ord", "path"), "ord")
    first = lambda r: r.groupBy("path").agg(F.min("ord").alias("ord"))
    old = knn.number(first(rows.where("ord % 3 <> 0")), "ord").select((F.col("position") - 1).alias("label"), "path")
    return knn.extend_index(old, first(rows))


@query("bass_rhythm_similarity", f"""WITH {sql.INDEX}, {_SEED_SQL}, p AS (SELECT i.ord, i.v, s.v AS s_v FROM idx i, s) SELECT ord, round({sql.contour(sql.BASS, sql.BASS.replace('v[', 's_v['), 64, True)}, 6) AS bass,
  round({sql.contour(sql.RHYTHM, sql.RHYTHM.replace('v[', 's_v['), 64, False)}, 6) AS rhythm FROM p""")
def bass_rhythm_similarity(spark, d):
    rows, seed, _ = seeded(spark, d)
    rows, halves = rank.contours(rows), {"bass": seed["v"][:64], "rhythm": seed["v"][64:]}
    lit = lambda c: F.array(*[F.lit(40 + 160 * abs(x)) for x in halves[c]])
    return rows.select("ord", F.round(V.contour_similarity(lit("bass"), F.col("bass"), 512, True), 6).alias("bass"), F.round(V.contour_similarity(lit("rhythm"), F.col("rhythm"), 256, False), 6).alias("rhythm"))


@query("cosine_pairs", f"""WITH {sql.VECTORS}, p AS (SELECT a.ord AS a, b.ord AS b, a.v AS x, b.v AS y FROM v a JOIN v b ON b.ord = a.ord + 1) SELECT a, b, round({sql.dot("x", "y")}, 6) AS dot,
  round(1 - {sql.dist("x", "y")}, 6) AS cosine, round(list_distance(x, y), 6) AS distance FROM p""")
def cosine_pairs(spark, d):
    v = vectors(spark, d)
    p = v.select(F.col("ord").alias("a"), F.col("v").alias("x"), (F.col("ord") + 1).alias("b")).join(v.select(F.col("ord").alias("b"), F.col("v").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    return p.select("a", "b", F.round(V.dot(x, y), 6).alias("dot"), F.round(V.cosine(x, y), 6).alias("cosine"), F.round(V.euclidean(x, y), 6).alias("distance"))


@query("embedding_blend", f"""WITH {sql.VECTORS}, p AS (SELECT a.ord, a.v AS x, b.v AS y FROM v b LEFT JOIN v a ON b.ord = a.ord + 2 WHERE a.ord IS NOT NULL)
  SELECT ord, round(list_sum(list_transform(range(1, 129), lambda i: (0.7 * x[i] + 0.3 * y[i]) * i)), 6) AS checksum FROM p""")
def embedding_blend(spark, d):
    v = vectors(spark, d)
    p = v.select("ord", F.col("v").alias("x"), (F.col("ord") + 2).alias("b")).join(v.select(F.col("ord").alias("b"), F.col("v").alias("y")), "b")
    weighted = F.aggregate(F.transform(V.blend(F.col("x"), F.col("y")), lambda z, i: z * (i + 1)), F.lit(0.0), lambda s, z: s + z)
    return p.select("ord", F.round(weighted, 6).alias("checksum"))


@query("window_pooling", f"""WITH {sql.VECTORS}, w AS (SELECT ord, unnest([v[1:32], v[33:64], v[65:96], v[97:128]]) AS s FROM v), e AS (SELECT ord, unnest(s) AS x, unnest(range(32)) AS p FROM w)
  SELECT ord, p::INTEGER AS p, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM e GROUP BY ord, p""")
def window_pooling(spark, d):
    w = vectors(spark, d).select("ord", F.explode(F.array(*[F.slice("v", s, 32) for s in (1, 33, 65, 97)])).alias("s")).select("ord", F.posexplode("s").alias("p", "x"))
    return w.groupBy("ord", "p").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("variance"))
