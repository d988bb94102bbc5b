"""Ranking of candidates around a seed: rules of harmony and tempo, weighted scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewave.functions import harmony as H
from cratewave.functions import scores as S
from cratewave.functions import text as T
from cratewave.functions import vectors as V
from cratewave.operators import knn

# Weights of the presets, in the order of WEIGHTS.
WEIGHTS = ("ann", "samples", "bass", "rhythm", "bpm", "key", "tags")
PRESETS = {
    "balanced": (0.6, 0.1, 0.1, 0.1, 0.05, 0.05, 0.0),
    "energy": (0.45, 0.35, 0.1, 0.05, 0.05, 0.0, 0.0),
    "groove": (0.4, 0.1, 0.2, 0.2, 0.05, 0.05, 0.0),
    "harmonic": (0.4, 0.05, 0.15, 0.05, 0.15, 0.2, 0.0),
    "pure_ann": (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}


#: What rankings return; no rows for a seed that was not found (None).
RESULT = "rank int, ord bigint, relation string, dist double, score double"


@dataclass
class RankingSpec:
    """Weights and filters of a ranking."""

    weights: dict[str, float] = field(default_factory=lambda: dict(zip(WEIGHTS, PRESETS["balanced"])))
    tempo_pct: float = 6.0
    camelot: bool = True
    doubletime: bool = True
    bpm_max_diff: float = 0.0
    allowed_relations: tuple[str, ...] = ()
    require_tags: tuple[str, ...] = ()
    prefer_tags: tuple[str, ...] = ()


def named(tracks: DataFrame, text: str) -> DataFrame:
    """Tracks whose path or label holds a text, whatever its case."""
    needle = text.lower()
    label = T.label(F.col("artist"), F.col("title"))
    return tracks.where(F.contains(F.lower("path"), F.lit(needle)) | F.contains(F.lower(label), F.lit(needle)))


def resolve_seed(indexed: DataFrame, text: str):
    """The first index row (label, ord, path, artist, title, ..., v) whose path or label holds a text, or None."""
    return named(indexed, text).orderBy("label").limit(1).first()


def contours(rows: DataFrame) -> DataFrame:
    """`rows` with a bass and a rhythm contour of 64 values each, read from the two halves of the vector v."""
    part = lambda start: F.transform(F.slice("v", start, 64), lambda x: 40 + 160 * F.abs(x))
    return rows.withColumn("bass", part(1)).withColumn("rhythm", part(65))


def _contoured(pool: DataFrame, seed, wanted: bool) -> tuple[DataFrame, dict[str, list[float]]]:
    """The pool with contours, made after its limit where they are wanted and not there, and those of the seed."""
    if not wanted:
        return pool, {}
    known = seed.asDict()
    if "bass" in pool.columns and "rhythm" in pool.columns:
        return pool, {c: known[c] for c in ("bass", "rhythm")}
    form = lambda v: [40 + 160 * abs(x) for x in v]
    return contours(pool), {"bass": form(known["v"][:64]), "rhythm": form(known["v"][64:128])}


def _pool(rows: DataFrame, seed, k: int, info: DataFrame | None) -> DataFrame:
    """The k rows nearest to a seed, without it. With `info` (ord, ...), `rows` needs only (ord, label, v): the other
    columns are fetched for the pool alone."""
    pool = knn.nearest_to(rows, seed["v"], k, "label").where(F.col("ord") != seed["ord"])
    if info is None:
        return pool
    return info.join(F.broadcast(pool), "ord")  # at most k rows


def _array(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]) if values else F.array().cast("array<double>")


def recommend(rows: DataFrame, seed, info: DataFrame | None = None, *, top: int = 25, extra: int = 50, tempo_pct: float = 6.0, doubletime: bool = True, camelot: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """Tracks that go with a seed row: the `top` + `extra` nearest others are the pool, rules filter the pool, and what
    is left is ordered by distance, or by the weighted score if any weight is set. Fewer than `top` rows may be left.

    `rows` has label, ord, v and, unless `info` has them by ord, camelot, bpm, samples; bass and rhythm are read from v where
    they are weighted and not there."""
    if seed is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    weights = {k: w for k, w in (weights or {}).items() if w}
    # the limit is a barrier: filters below it would change the pool
    pool, own = _contoured(_pool(rows, seed, top + extra, info), seed, bool({"bass", "rhythm"} & set(weights)))
    key, bpm = F.lit(seed["camelot"]).cast("string"), F.lit(seed["bpm"]).cast("double")
    out = pool.withColumn("relation", H.relation(key, F.col("camelot")))
    if camelot:
        out = out.where(H.compatible(key, F.col("camelot")))
    out = out.where(H.tempo_matches(bpm, F.col("bpm"), tempo_pct, doubletime))
    score = F.lit(0.0)
    if "ann" in weights:
        score = score + weights["ann"] * (1 - F.col("dist"))
    if "samples" in weights:
        score = score + weights["samples"] * F.coalesce("samples", F.lit(0.0))
    for name, length, log in (("bass", 512, True), ("rhythm", 256, False)):
        if name in weights:
            score = score + weights[name] * F.coalesce(V.contour_similarity(_array(own[name]), F.col(name), length, log), F.lit(0.0))
    out = out.withColumn("score", score)
    order = [F.desc("score"), "dist", "label"] if weights else ["dist", "label"]
    return ranked(out.orderBy(*order).limit(top), order).select("rank", "ord", "relation", F.round("dist", 6).alias("dist"), F.round("score", 6).alias("score"))


def ranked(few: DataFrame, order: list) -> DataFrame:
    """`few` rows (after a limit) with their rank."""
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def recommend_for_all(queries: DataFrame, rows: DataFrame, tracks: DataFrame, *, top: int = 10, extra: int = 50, tempo_pct: float = 6.0, doubletime: bool = True) -> DataFrame:
    """The same for every query (ord, v) at once: pools by blocks, then rules, then `top` by distance."""
    info = tracks.select("ord", "camelot", "bpm")
    pool = knn.nearest_for_all(queries, rows, top + extra)
    seeds = info.select(F.col("ord").alias("q"), F.col("camelot").alias("q_camelot"), F.col("bpm").alias("q_bpm"))
    fit = pool.join(info, "ord").join(seeds, "q").where(H.compatible(F.col("q_camelot"), F.col("camelot")) & H.tempo_matches(F.col("q_bpm"), F.col("bpm"), tempo_pct, doubletime))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("dist", 9), "ord"))
    return fit.select("q", "ord", "dist").withColumn("rank", rank).where(F.col("rank") <= top).select("q", "rank", "ord", F.round("dist", 6).alias("dist"))


def sequence(rows: DataFrame, seeds: DataFrame, *, top: int = 25, pool: int = 100) -> DataFrame:
    """The tracks nearest to the mean of a few seed rows (ord, v), without the seeds."""
    mean = knn.mean_vector(seeds)
    if mean is None:
        return rows.select(F.lit(0).alias("rank"), "ord", F.lit(0.0).alias("dist")).limit(0)
    near = knn.nearest_to(rows, mean, pool, "label").join(seeds.select("ord"), "ord", "left_anti").orderBy("dist", "label").limit(top)
    return ranked(near, ["dist", "label"]).select("rank", "ord", F.round("dist", 6).alias("dist"))


def discover(rows: DataFrame, seed, spec: RankingSpec, info: DataFrame | None = None, *, top: int = 50) -> DataFrame:
    """Weighted discovery: the nearest 4 x `top` rows, filtered by tempo, tags and key relations, by a score over the
    sum of the weights. `rows` has label, ord, v and, unless `info` has them by ord, camelot, bpm, samples, tags, mytags."""
    if seed is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    w = {k: spec.weights.get(k, 0.0) for k in WEIGHTS}
    total = sum(w.values())
    total = total if total > 0 else 1.0
    both = lambda r: F.array_union(T.clean_tags(r[0]), T.clean_tags(r[1]))
    strings = lambda values: F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")
    pool, own = _contoured(_pool(rows, seed, 4 * top, info), seed, bool(w["bass"] or w["rhythm"]))
    key, bpm = F.lit(seed["camelot"]).cast("string"), F.lit(seed["bpm"]).cast("double")
    out = pool.withColumn("all_tags", both((F.col("tags"), F.col("mytags"))))
    known = F.coalesce((bpm > 0) & (F.col("bpm") > 0), F.lit(False))
    if spec.bpm_max_diff > 0:
        out = out.where(~known | (F.abs(bpm - F.col("bpm")) <= spec.bpm_max_diff))
    out = out.where(H.tempo_matches(bpm, F.col("bpm"), spec.tempo_pct, spec.doubletime))
    if spec.require_tags:
        out = out.where(F.size(F.array_except(strings(spec.require_tags), F.col("all_tags"))) == 0)
    key_score = H.relation_score(key, F.col("camelot"))
    bucket = F.when(key_score >= 0.99, "same").when(key_score >= 0.79, "relative").when(key_score >= 0.69, "neighbor").otherwise(H.relation(key, F.col("camelot")))
    if spec.allowed_relations:
        out = out.where(bucket.isin(*spec.allowed_relations))
    elif spec.camelot:
        out = out.where(H.compatible(key, F.col("camelot")))
    seed_tags = sorted({t.strip() for t in (seed["tags"] or []) + (seed["mytags"] or []) if t and t.strip()} | set(spec.prefer_tags))
    score = w["ann"] * (1 - F.col("dist")) + w["samples"] * F.coalesce("samples", F.lit(0.0))
    for name, length, log in (("bass", 512, True), ("rhythm", 256, False)):
        if w[name]:
            score = score + w[name] * F.coalesce(V.contour_similarity(_array(own[name]), F.col(name), length, log), F.lit(0.0))
    score = score + F.when(known, w["bpm"] * H.tempo_score(bpm, F.col("bpm"), spec.bpm_max_diff or spec.tempo_pct)).otherwise(0.0)
    score = score + w["key"] * key_score + w["tags"] * S.jaccard(strings(seed_tags), F.col("all_tags"))
    out = out.withColumn("score", F.round(score / total, 9))
    order = [F.desc("score"), "label"]
    return ranked(out.orderBy(*order).limit(top), order).select("rank", "ord", bucket.alias("relation"), F.round("dist", 6).alias("dist"), F.round("score", 6).alias("score"))
