"""Learning tag profiles from tagged tracks, suggesting and pruning tags, choosing what to label next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewave.functions import scores as S
from cratewave.functions import text as T
from cratewave.functions import vectors as V
from cratewave.operators import knn
from cratewave.storage import materialize

#: Tags that profiles are learned and shipped for at most: a vocabulary, not data (10,000 x 128 numbers are 10 MB).
MAX_PROFILES = 10_000


def tagged(tracks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(ord, pos, tag, v) of every tag of every track with a vector, repetitions included."""
    return tracks.select("ord", F.posexplode(T.clean_tags(F.col("mytags"))).alias("pos", "tag")).join(vectors.select("ord", V.unit(F.col("v")).alias("v")), "ord")


def _listed(tracks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(tags, v) of the tracks with tags and a vector, written once because two passes read it."""
    tags = T.clean_tags(F.col("mytags"))
    return materialize(tracks.select("ord", tags.alias("tags")).where(F.size("tags") > 0).join(vectors.select("ord", "v"), "ord").select("tags", "v"), "tagged")


def _unit_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Unit vectors of a batch of (tags, v), the row of each tag, and the tags."""
    x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    lengths = b.column("tags").value_lengths().to_numpy(zero_copy_only=False)
    return np.divide(x, n, out=x.copy(), where=n > 0), np.repeat(np.arange(b.num_rows), lengths), b.column("tags").flatten().to_pylist()


def profiles(tracks: DataFrame, vectors: DataFrame, min_samples: int = 3) -> DataFrame:
    """(tag, samples, centroid, mean_sim, std_sim, threshold) of every tag with at least `min_samples` tagged tracks.

    The centroid is the unit mean of the unit vectors; the threshold is the mean similarity to it less the population's
    standard deviation. Both passes add up per batch before anything is shuffled, so a tag that a third of all tracks
    carry sends as little as any other. No tagged tracks give no rows."""
    rows = _listed(tracks, vectors)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner, tags = _unit_rows(b)
            names, inverse = np.unique(np.array(tags, dtype=object).astype(str), return_inverse=True)
            if not len(names):
                continue
            order = np.argsort(inverse, kind="stable")
            edges = np.flatnonzero(np.diff(inverse[order], prepend=-1))
            s = np.add.reduceat(x[owner[order]], edges, axis=0)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(np.bincount(inverse, minlength=len(names)).astype(np.int64)), flat], ["tag", "n", "s"])

    sums = rows.mapInArrow(add, "tag string, n bigint, s array<double>").select("tag", "n", F.posexplode("s").alias("p", "x"))
    sums = sums.groupBy("tag", "p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).where(F.col("n") >= max(1, min_samples))
    centre = sums.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("p", (F.col("x") / F.col("n")).alias("x")))).alias("c"), F.max("n").alias("samples")).select("tag", "samples", V.unit(F.col("c.x")).alias("centroid"))
    centre = materialize(centre, "centroids")
    known = {r["tag"]: np.array(r["centroid"]) for r in centre.select("tag", "centroid").limit(MAX_PROFILES + 1).collect()}
    if len(known) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} tags: learn them in parts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner, tags = _unit_rows(b)
            got: dict[str, list[float]] = {}
            at = [i for i, t in enumerate(tags) if t in known]
            sims = np.einsum("ij,ij->i", x[owner[at]], np.array([known[tags[i]] for i in at])) if at else []
            for i, v in zip(at, sims):
                g = got.setdefault(tags[i], [0, 0.0, 0.0])
                g[0] += 1
                g[1] += v
                g[2] += v * v
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(got), pa.string()), *(pa.array([g[k] for g in got.values()], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64())))], ["tag", "n", "s", "q"]
            )

    total = rows.mapInArrow(spread, "tag string, n bigint, s double, q double").groupBy("tag").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sims = total.select("tag", mean.alias("mean_sim"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std_sim"))
    return centre.join(sims, "tag").withColumn("threshold", F.col("mean_sim") - F.col("std_sim"))


def _vocabulary(profile_table: DataFrame) -> tuple[list[tuple[str, list[float]]], np.ndarray]:
    """(tag, centroid) of the profiles in the order of their tags, and their thresholds; a vocabulary of checked size."""
    kept = sorted(profile_table.select("tag", "centroid", "threshold").limit(MAX_PROFILES + 1).collect(), key=lambda r: r["tag"])
    if len(kept) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} tags: score them in parts")
    return [(r["tag"], list(r["centroid"])) for r in kept], np.array([r["threshold"] for r in kept])


def scored(rows: DataFrame, profile_table: DataFrame, normalise: bool = True) -> DataFrame:
    """(ord, tag, score, threshold) of every row (ord, v) and every profile: a long table; what follows below takes its
    part of the scores where they are made."""
    known, limits = _vocabulary(profile_table)
    names = pa.array([t for t, _ in known], pa.string())

    def take(s: np.ndarray) -> tuple:
        row, tag = np.divmod(np.arange(s.size), max(1, s.shape[1]))
        return row, names.take(pa.array(tag)), pa.array(s.ravel()), pa.array(limits[tag])

    return knn.score_batches(rows, known, take, "ord bigint, tag string, score double, threshold double", normalise=normalise)


def _picked(rows: DataFrame, profile_table: DataFrame, order: Callable[[np.ndarray, np.ndarray], np.ndarray], top_k: int) -> DataFrame:
    """(ord, rank, tag, score, threshold) of the tags of each row in the order of some values (row, profile), the smallest
    first, infinite ones left out; ties go by tag. Ranked within the batch: nothing is shuffled."""
    known, limits = _vocabulary(profile_table)
    names = pa.array([t for t, _ in known], pa.string())

    def take(s: np.ndarray) -> tuple:
        value = order(s, limits)
        best = np.argsort(value, axis=1, kind="stable")  # tags stand in their order
        best = best[:, :top_k] if top_k > 0 else best
        row, rank = np.nonzero(np.isfinite(np.take_along_axis(value, best, axis=1)))
        tag = best[row, rank]
        return row, pa.array((rank + 1).astype(np.int32)), names.take(pa.array(tag)), pa.array(s[row, tag]), pa.array(limits[tag])

    return knn.score_batches(rows, known, take, "ord bigint, rank int, tag string, score double, threshold double")


def suggest(rows: DataFrame, profile_table: DataFrame, margin: float = 0.0, top_k: int = 3) -> DataFrame:
    """(ord, rank, tag, score, threshold) of the best tags of each row that reach their threshold less the margin. With
    `top_k` of 0 all are kept; ties go by tag."""
    return _picked(rows, profile_table, lambda s, limits: np.where(s >= limits - margin, -np.round(s, 9), np.inf), top_k)


def evaluate(tracks: DataFrame, vectors: DataFrame, profile_table: DataFrame) -> DataFrame:
    """(ord, tag, score, threshold) of the tags that tracks carry and that have a profile, each once."""
    rows = tagged(tracks, vectors).dropDuplicates(["ord", "tag"])
    return rows.join(profile_table.select("tag", "centroid", "threshold"), "tag").select("ord", "tag", V.dot(F.col("v"), F.col("centroid")).alias("score"), "threshold")


def prune(evaluated: DataFrame, prune_margin: float) -> DataFrame:
    """Carried tags that score below their threshold by more than the margin; none without a positive margin."""
    return evaluated.where((F.col("score") < F.col("threshold") - prune_margin) & F.lit(prune_margin > 0))


def apply(tracks: DataFrame, suggested: DataFrame, pruned: DataFrame) -> DataFrame:
    """(ord, tags) of the tracks whose sorted tags change when suggestions are added and pruned tags taken away."""
    gather = lambda df, name: df.groupBy("ord").agg(F.collect_set("tag").alias(name))
    empty = F.array().cast("array<string>")
    changes = gather(suggested, "more").join(gather(pruned, "less"), "ord", "full_outer")
    own = F.array_sort(F.array_distinct(T.clean_tags(F.col("mytags"))))
    new = F.array_sort(F.array_except(F.array_union(own, F.coalesce("more", empty)), F.coalesce("less", empty)))
    return tracks.join(changes, "ord").select("ord", own.alias("old"), new.alias("tags")).where("old <> tags").select("ord", "tags")


def suggestion_rows(suggested: DataFrame, pruned: DataFrame) -> DataFrame:
    """Rows of the suggestion file: type, ord, tag, score, threshold, delta."""
    row = lambda df, kind: df.select(F.lit(kind).alias("type"), "ord", "tag", "score", "threshold", (F.col("score") - F.col("threshold")).alias("delta"))
    return row(suggested, "suggest").unionByName(row(pruned, "prune"))


def snapshot(suggested: DataFrame, pruned: DataFrame) -> DataFrame:
    """(ord, candidates, low_confidence): suggestions nested by track; tracks that only lose tags are left out."""
    nest = lambda df, name: df.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct(F.round("score", 6).alias("score"), "tag"))).alias(name))
    return nest(suggested, "candidates").join(nest(pruned, "low_confidence"), "ord", "left")


def untagged(tracks: DataFrame, user_tags: DataFrame | None = None) -> DataFrame:
    """Tracks without tags, or, with `user_tags` (path, tag), tracks that this store does not know."""
    if user_tags is not None:
        return tracks.join(user_tags.select("path"), "path", "left_anti")
    return tracks.where(F.size(T.clean_tags(F.col("mytags"))) == 0)


STRATEGIES = ("margin", "entropy", "least_confidence")


def uncertainty(score_rows: DataFrame, strategy: str = "margin", top_k: int = 10) -> DataFrame:
    """(rank, ord, uncertainty, top_tags, reason) of the rows whose tags are least clear; NaN comes last, ties by ord.

    Strategies: margin, entropy, least_confidence; others raise ValueError. `score_rows` is (ord, tag, score) over a
    vocabulary, so that the list of one row is bounded."""
    lists = score_rows.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("score", "tag")), asc=False).alias("s"))
    s: Column = F.col("s.score")
    values = dict(zip(STRATEGIES, (1 - S.margin(s), S.entropy(s), S.least_confidence(s))))
    if strategy not in values:
        raise ValueError(f"unknown strategy {strategy!r}")
    return _least_clear(lists.select("ord", values[strategy].alias("uncertainty"), F.slice("s", 1, 3).alias("best")), strategy, top_k)


def _least_clear(rows: DataFrame, strategy: str, top_k: int) -> DataFrame:
    """The result of `uncertainty` from (ord, uncertainty, best three tags)."""
    order = [F.isnan("uncertainty"), F.desc("uncertainty"), "ord"]
    few = rows.withColumn("uncertainty", F.round("uncertainty", 9)).orderBy(*order).limit(top_k)
    return few.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"), "ord", "uncertainty", F.array_join(F.transform("best", lambda x: x["tag"]), ", ").alias("top_tags"), explain(F.col("best"), strategy).alias("reason")
    )


def least_clear(rows: DataFrame, profile_table: DataFrame, strategy: str = "margin", top_k: int = 10) -> DataFrame:
    """The result of `uncertainty` for rows (ord, v) and profiles. One value and three tags of each row leave the matrix
    product; the scores themselves are never shuffled. Without profiles there are no rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    known, _ = _vocabulary(profile_table)
    names = pa.array([t for t, _ in known], pa.string())

    def take(s: np.ndarray) -> tuple:
        best = np.argsort(-s[:, ::-1], axis=1, kind="stable")[:, :3]  # of equal scores the later tag stands first
        best = s.shape[1] - 1 - best
        top = np.take_along_axis(s, best, axis=1)
        if strategy == "margin":
            value = 1 - (top[:, 0] - top[:, 1]) if s.shape[1] > 1 else np.zeros(len(s))
        elif strategy == "least_confidence":
            value = 1 - top[:, 0]
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                total = s.sum(axis=1, keepdims=True)
                value = np.where(total[:, 0] == 0, 0.0, -(s / total * np.log(s / total + 1e-10)).sum(axis=1))
        pairs = pa.StructArray.from_arrays([pa.array(top.ravel()), names.take(pa.array(best.ravel()))], ["score", "tag"])
        return np.arange(len(s)), pa.array(value), pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * best.shape[1]), pairs)

    return _least_clear(knn.score_batches(rows, known, take, "ord bigint, uncertainty double, best array<struct<score:double,tag:string>>"), strategy, top_k)


# Texts that tell why a row counts as uncertain; in order: the first tag and its percent, the second and its.
REASONS = {"none": "No confident predictions", "margin": "I'm %2$s sure it's '%1$s' but %4$s sure it's '%3$s'. Which is it?", "entropy": "Could be any of: ", "least": "Best guess is '%1$s' but only %2$s confident"}


def explain(best: Column, strategy: str) -> Column:
    """Why a row counts as uncertain, in words, from its tags (score, tag), the best first. Percents are rounded; a close
    call needs two tags, else the best guess is named."""
    percent = lambda x: F.format_string("%.0f%%", x["score"] * 100)
    first, second = F.try_element_at(best, F.lit(1)), F.try_element_at(best, F.lit(2))
    guess = F.format_string(REASONS["least"], first["tag"], percent(first))
    told = guess
    if strategy == "margin":
        told = F.when(F.size(best) < 2, guess).otherwise(F.format_string(REASONS["margin"], first["tag"], percent(first), second["tag"], percent(second)))
    if strategy == "entropy":
        named = F.transform(F.slice(best, 1, 3), lambda x: F.format_string("'%s' (%s)", x["tag"], percent(x)))
        told = F.concat(F.lit(REASONS["entropy"]), F.array_join(named, ", "))
    return F.when(F.size(best) == 0, F.lit(REASONS["none"])).otherwise(told)


def near_threshold(rows: DataFrame, profile_table: DataFrame, margin: float) -> DataFrame:
    """(ord, rank, tag, score, threshold) within a margin of the threshold, the closest first."""

    def gap(s: np.ndarray, limits: np.ndarray) -> np.ndarray:
        d = np.abs(s - limits)
        return np.where(d <= margin, np.round(d, 9), np.inf)

    return _picked(rows, profile_table, gap, 0)


def bootstrap(rows: DataFrame, profile_table: DataFrame, tag: str, top_k: int = 20) -> DataFrame:
    """(rank, ord, score) of the rows that fit one tag best; no rows for a tag without a profile. Only its profile is
    scored."""
    order = [F.desc(F.round("score", 9)), "ord"]
    few = scored(rows, profile_table.where(F.col("tag") == tag)).orderBy(*order).limit(top_k)
    return few.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "ord", "score")


def needs_more(profile_table: DataFrame, least: int) -> DataFrame:
    """(tag, samples, missing) of tags with too few examples, most wanting first."""
    return profile_table.where(F.col("samples") < least).select("tag", "samples", (F.lit(least) - F.col("samples")).alias("missing")).orderBy(F.desc("missing"), "tag")


def diverse(rows: DataFrame, n: int) -> DataFrame:
    """(pick, ord): farthest-first choice of n rows (ord, v, uncertainty) from the most uncertain on; all of them if there
    are no more than n.

    Each step is one aggregate over the table, which keeps its distance to the chosen rows, so any number of rows works;
    n itself is small (a list for a person), and the chosen vectors are all that reaches the driver."""
    first = rows.orderBy(F.desc("uncertainty"), "ord").limit(1).collect()
    if not first:
        return rows.select(F.lit(0).alias("pick"), "ord").limit(0)
    chosen, last = [first[0]["ord"]], first[0]["v"]
    left = materialize(rows.select("ord", "v", F.lit(float("inf")).alias("d")), "diverse")
    while len(chosen) < n:
        left = left.where(F.col("ord") != chosen[-1]).withColumn("d", F.least("d", V.euclidean(F.col("v"), F.array(*[F.lit(float(x)) for x in last]))))
        if len(chosen) % 8 == 0:
            left = materialize(left, "diverse")
        best = left.orderBy(F.desc(F.round("d", 9)), "ord").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["ord"])
        last = best[0]["v"]
    return rows.sparkSession.createDataFrame([(i + 1, o) for i, o in enumerate(chosen)], "pick int, ord bigint")
