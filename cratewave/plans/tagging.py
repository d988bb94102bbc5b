"""Queries that learn tags and choose what to label."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewave.operators import tags as G
from cratewave.plans import register, sql
from cratewave.plans.library import tracks, vectors
from cratewave.storage import materialize

query, QUERIES, ORACLES = register()

_UNIT = f"u AS (SELECT ord, list_transform(v, lambda x: x / sqrt({sql.dot('v', 'v')})) AS v FROM v)"
_LEARN = f"""WITH {sql.VECTORS}, {_UNIT}, tg AS ({sql.exploded()}), m AS (SELECT tg.ord, tg.pos, tg.tag, u.v FROM tg JOIN u USING (ord)),
  e AS (SELECT tag, unnest(v) AS x, unnest(range(128)) AS p FROM m), a AS (SELECT tag, p, avg(x) AS x, count(*) AS n FROM e GROUP BY tag, p HAVING count(*) >= 3),
  c0 AS (SELECT tag, list(x ORDER BY p) AS c, max(n) AS samples FROM a GROUP BY tag), c AS (SELECT tag, samples, list_transform(c, lambda x: x / sqrt({sql.dot('c', 'c')})) AS centroid FROM c0),
  st AS (SELECT m.tag, avg({sql.dot('m.v', 'c.centroid')}) AS mean_sim, stddev_pop({sql.dot('m.v', 'c.centroid')}) AS std_sim FROM m JOIN c USING (tag) GROUP BY m.tag),
  prof AS (SELECT c.tag, c.samples, c.centroid, mean_sim, std_sim, mean_sim - std_sim AS threshold FROM c JOIN st USING (tag))"""
_FREE = f"free AS (SELECT t.ord, u.v FROM tracks t JOIN u USING (ord) WHERE len({sql.tags('mytags')}) = 0)"
_SCORED = f"{_LEARN}, {_FREE}, sc AS (SELECT f.ord, p.tag, {sql.dot('f.v', 'p.centroid')} AS score, p.threshold FROM free f, prof p)"
_SUGGEST = f"{_SCORED}, sg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(score, 9) DESC, tag) AS rank FROM sc WHERE score >= threshold) WHERE rank <= 3)"
_EVAL = f"ev AS (SELECT DISTINCT m.ord, m.tag, {sql.dot('m.v', 'p.centroid')} AS score, p.threshold FROM m JOIN prof p USING (tag))"
_PRUNE = "pr AS (SELECT * FROM ev WHERE score < threshold - 0.02)"


def learned(spark, d):
    """(tracks, vectors, profiles)"""
    t, v = tracks(spark, d), vectors(spark, d)
    return t, v, materialize(G.profiles(t, v), "profiles")


def free_rows(t, v):
    return G.untagged(t).select("ord").join(v.select("ord", "v"), "ord")


def unlabelled(spark, d):
    """(rows to score, profiles): the untagged tracks and what was learned of the others."""
    t, v, p = learned(spark, d)
    return free_rows(t, v), p


def suggested(spark, d):
    t, v, p = learned(spark, d)
    return G.suggest(free_rows(t, v), p)


def pruned(spark, d):
    t, v, p = learned(spark, d)
    return G.prune(G.evaluate(t, v, p), 0.02)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("tag_profiles", f"{_LEARN} SELECT tag, samples, round(mean_sim, 6) AS mean_sim, round(std_sim, 6) AS std_sim, round(threshold, 6) AS threshold, round(centroid[1], 6) AS first_element FROM prof")
def tag_profiles(spark, d):
    _, _, p = learned(spark, d)
    return _rounded(p, "mean_sim", "std_sim", "threshold").select("tag", "samples", "mean_sim", "std_sim", "threshold", F.round(F.element_at("centroid", 1), 6).alias("first_element"))


@query("tag_suggest", f"{_SUGGEST} SELECT ord, rank, tag, round(score, 6) AS score, round(threshold, 6) AS threshold FROM sg")
def tag_suggest(spark, d):
    return _rounded(suggested(spark, d), "score", "threshold")


@query("tag_evaluate", f"{_LEARN}, {_EVAL} SELECT ord, tag, round(score, 6) AS score, round(threshold, 6) AS threshold FROM ev")
def tag_evaluate(spark, d):
    t, v, p = learned(spark, d)
    return _rounded(G.evaluate(t, v, p), "score", "threshold")


@query("tag_prune", f"{_LEARN}, {_EVAL}, {_PRUNE} SELECT ord, tag, round(score, 6) AS score, round(threshold, 6) AS threshold FROM pr")
def tag_prune(spark, d):
    return _rounded(pruned(spark, d), "score", "threshold")


@query("tag_apply", f"""{_SUGGEST}, {_EVAL}, {_PRUNE}, o AS (SELECT ord, list_sort(list_distinct({sql.tags('mytags')})) AS old FROM tracks),
  more AS (SELECT ord, list(tag) AS more FROM sg GROUP BY ord), less AS (SELECT ord, list(DISTINCT tag) AS less FROM pr GROUP BY ord),
  n AS (SELECT o.ord, old, list_sort(list_filter(list_distinct(list_concat(old, coalesce(more, []::VARCHAR[]))), lambda x: NOT list_contains(coalesce(less, []::VARCHAR[]), x))) AS tags
    FROM o LEFT JOIN more USING (ord) LEFT JOIN less USING (ord)) SELECT ord, array_to_string(tags, '|') AS tags FROM n WHERE old <> tags""")
def tag_apply(spark, d):
    return G.apply(tracks(spark, d), suggested(spark, d), pruned(spark, d)).select("ord", F.array_join("tags", "|").alias("tags"))


@query("tag_suggestion_rows", f"""{_SUGGEST}, {_EVAL}, {_PRUNE}, r AS (SELECT 'suggest' AS type, ord, tag, score, threshold FROM sg UNION ALL SELECT 'prune', ord, tag, score, threshold FROM pr)
  SELECT type, ord, tag, round(score, 6) AS score, round(threshold, 6) AS threshold, round(score - threshold, 6) AS delta FROM r""")
def tag_suggestion_rows(spark, d):
    return _rounded(G.suggestion_rows(suggested(spark, d), pruned(spark, d)), "score", "threshold", "delta")


@query("tag_snapshot", f"""{_SUGGEST}, {_EVAL}, {_PRUNE}, l AS (SELECT ord, count(*) AS n FROM pr GROUP BY ord) SELECT sg.ord, array_to_string(list(tag ORDER BY round(score, 6), tag), '|') AS candidates, any_value(coalesce(l.n, 0)) AS low_confidence
  FROM sg LEFT JOIN l ON l.ord = sg.ord GROUP BY sg.ord""")
def tag_snapshot(spark, d):
    s = G.snapshot(suggested(spark, d), pruned(spark, d))
    return s.select("ord", F.array_join("candidates.tag", "|").alias("candidates"), F.coalesce(F.when(F.col("low_confidence").isNotNull(), F.size("low_confidence")), F.lit(0)).cast("bigint").alias("low_confidence"))


_LISTS = f"{_SCORED}, li AS (SELECT ord, list(score ORDER BY score DESC, tag DESC) AS s, list(tag ORDER BY score DESC, tag DESC) AS t FROM sc GROUP BY ord)"


def _uncertain(value: str, reason: str) -> str:
    return f"""{_LISTS}, un AS (SELECT ord, round({value}, 9) AS u, array_to_string(t[1:3], ', ') AS top_tags, {reason} AS reason FROM li)
      SELECT row_number() OVER (ORDER BY isnan(u), u DESC, ord) AS rank, ord, u AS uncertainty, top_tags, reason FROM un ORDER BY isnan(u), u DESC, ord LIMIT 10"""


def _strategy(name: str, strategy: str, value: str, reason: str) -> None:
    @query(name, _uncertain(value, reason))
    def uncertain(spark, d):
        return G.least_clear(*unlabelled(spark, d), strategy)


_TOTAL = "list_sum(s)"
_GUESS = "printf('Best guess is ''%s'' but only %.0f%% confident', t[1], s[1] * 100)"
_CLOSE = f"CASE WHEN len(s) < 2 THEN {_GUESS} ELSE printf('I''m %.0f%% sure it''s ''%s'' but %.0f%% sure it''s ''%s''. Which is it?', s[1] * 100, t[1], s[2] * 100, t[2]) END"
_ANY = "'Could be any of: ' || array_to_string(list_transform(range(1, least(len(s), 3) + 1), lambda i: printf('''%s'' (%.0f%%)', t[i], s[i] * 100)), ', ')"
_strategy("uncertain_margin", "margin", "CASE WHEN len(s) < 2 THEN 0.0 ELSE 1 - (s[1] - s[2]) END", _CLOSE)
_strategy("uncertain_entropy", "entropy", f"CASE WHEN {_TOTAL} = 0 THEN 0.0 WHEN list_min(s) / {_TOTAL} + 1e-10 < 0 OR list_max(s) / {_TOTAL} + 1e-10 < 0 THEN 'nan'::DOUBLE"
          f" ELSE -list_sum(list_transform(s, lambda x: x / {_TOTAL} * ln(greatest(x / {_TOTAL} + 1e-10, 1e-300)))) END", _ANY)
_strategy("uncertain_least_conf", "least_confidence", "1 - list_max(s)", _GUESS)


@query("near_threshold", f"{_SCORED} SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY round(abs(score - threshold), 9), tag) AS rank, tag, round(score, 6) AS score, round(threshold, 6) AS threshold FROM sc WHERE abs(score - threshold) <= 0.05")
def near_threshold(spark, d):
    return _rounded(G.near_threshold(*unlabelled(spark, d), 0.05), "score", "threshold")


@query("tag_bootstrap", f"{_SCORED} SELECT row_number() OVER (ORDER BY round(score, 9) DESC, ord) AS rank, ord, round(score, 6) AS score FROM sc WHERE tag = 'After Hours' ORDER BY round(score, 9) DESC, ord LIMIT 20")
def tag_bootstrap(spark, d):
    return _rounded(G.bootstrap(*unlabelled(spark, d), "After Hours"), "score")


@query("needs_more_samples", f"{_LEARN} SELECT tag, samples, 60 - samples AS missing FROM prof WHERE samples < 60")
def needs_more_samples(spark, d):
    return G.needs_more(learned(spark, d)[2], 60)


@query("diversity_sample", None)
def diversity_sample(spark, d):
    rows, p = unlabelled(spark, d)
    worst = G.least_clear(rows, p, "margin", 50).select("ord", "uncertainty")
    return G.diverse(rows.join(worst, "ord"), 10)


@query("tag_usage_untagged", f"SELECT t.ord FROM tracks t WHERE t.path NOT IN (SELECT track FROM correction_log WHERE track IS NOT NULL)")
def tag_usage_untagged(spark, d):
    from cratewave.session import table

    store = table(spark, d, "correction_log").where("track is not null").select(F.col("track").alias("path"), "tag")
    return G.untagged(tracks(spark, d), store).select("ord")
