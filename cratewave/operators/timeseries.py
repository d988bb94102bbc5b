"""Beats and other series of a track: intervals, tempo, segments, confidence, extrema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(beats: DataFrame, key: str = "path") -> DataFrame:
    """Beats (key, i, t) with the time since the one before as `gap`, null at the first."""
    return beats.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("i")))


def tempo_of(gap: Column) -> Column:
    """60 over a median gap; 0 if there is none or it is not positive."""
    return F.when(gap > 0, 60.0 / gap).otherwise(0.0)


def tempo(beats: DataFrame, key: str = "path") -> DataFrame:
    """(key, beats, bpm): tempo from the median gap."""
    return intervals(beats, key).groupBy(key).agg(F.count("*").alias("beats"), F.percentile("gap", F.lit(0.5)).alias("m")).select(key, "beats", tempo_of(F.col("m")).alias("bpm"))


def sliding_tempo(beats: DataFrame, bars: int = 16, key: str = "path") -> DataFrame:
    """(key, i, t, bpm): tempo of the w = max(4, 4 * bars) beats before each beat, 0 where there are less than two."""
    w = max(4, 4 * bars)
    frame = Window.partitionBy(key).orderBy("i").rowsBetween(-(w - 1), -1)
    return intervals(beats, key).withColumn("m", F.expr("percentile(gap, 0.5)").over(frame)).select(key, "i", "t", tempo_of(F.col("m")).alias("bpm"))


def segments(beats: DataFrame, mode: str = "fixed", drift_pct: float = 1.5, bars: int = 16, key: str = "path") -> DataFrame:
    """(key, segment, start, bpm): stretches of even tempo.

    `fixed` gives one from 0.0 with the tempo of all beats. `dynamic` walks the beats of a track: where the tempo of the
    last w beats leaves that of the segment by more than `drift_pct` percent, a segment ends and one begins w beats back.
    The walk is a fold over the beats of one track, a list that the length of a track bounds."""
    whole = tempo(beats, key)
    if mode == "fixed":
        return whole.select(key, F.lit(1).alias("segment"), F.lit(0.0).alias("start"), "bpm")
    w = max(4, 4 * bars)
    # the first window may have less than w beats: its tempo is that of the first min(n, w) beats
    first = intervals(beats, key).where(F.col("i") < w).groupBy(key).agg(F.percentile("gap", F.lit(0.5)).alias("m")).select(key, tempo_of(F.col("m")).alias("first_bpm"))
    rows = sliding_tempo(beats, bars, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "t", "bpm"))).alias("b"))
    state = F.struct(F.lit(0).alias("start"), F.col("first_bpm").alias("bpm"), F.array().cast("array<struct<start:double,bpm:double>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        leaves = (x["i"] >= w) & (s["bpm"] > 0) & (F.abs(x["bpm"] - s["bpm"]) / s["bpm"] * 100 > drift_pct)
        ended = F.concat(s["done"], F.array(F.struct(F.element_at("b", s["start"] + 1)["t"].alias("start"), s["bpm"].alias("bpm"))))
        return F.struct(
            F.when(leaves, F.greatest(F.lit(0), x["i"] - w)).otherwise(s["start"]).cast("int").alias("start"),
            F.when(leaves, x["bpm"]).otherwise(s["bpm"]).alias("bpm"), F.when(leaves, ended).otherwise(s["done"]).alias("done"),
        )

    end = lambda s: F.concat(s["done"], F.array(F.struct(F.element_at("b", s["start"] + 1)["t"].alias("start"), s["bpm"].alias("bpm"))))
    walked = rows.join(first, key).join(whole.select(key, F.col("bpm").alias("all_bpm")), key)
    found = F.when(F.col("all_bpm") <= 0, F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("bpm")))).otherwise(F.aggregate("b", state, step, end))
    return walked.select(key, F.posexplode(found).alias("p", "s")).select(key, (F.col("p") + 1).alias("segment"), "s.start", "s.bpm")


def confidence(onsets: DataFrame, key: str = "path") -> DataFrame:
    """(key, confidence): mean onset strength at beats over the highest strength, between 0 and 1, of rows (key, strength,
    is_beat); 0 without beats or strength."""
    agg = onsets.groupBy(key).agg(F.avg(F.when(F.col("is_beat"), F.col("strength"))).alias("m"), F.max("strength").alias("top"))
    return agg.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(F.col("top") > 0, F.col("m") / F.col("top")), F.lit(0.0)))).alias("confidence"))


def with_fallback(results: DataFrame, least: float = 0.3) -> DataFrame:
    """Results of two beat trackers (bpm, confidence, beats, bpm2, confidence2, beats2) with the `chosen` one: the second
    where the first is unsure and the second found beats and is surer, or the first found none."""
    second = (F.coalesce("confidence", F.lit(0.0)) < least) & (F.coalesce("beats2", F.lit(0)) > 0) & ((F.coalesce("beats", F.lit(0)) == 0) | (F.col("confidence2") > F.coalesce("confidence", F.lit(0.0))))
    second = F.coalesce(second, F.lit(False))
    pick = lambda c: F.when(second, F.col(f"{c}2")).otherwise(F.col(c))
    return results.withColumns({"chosen": F.when(second, "second").otherwise("first"), "bpm_chosen": pick("bpm"), "confidence_chosen": pick("confidence")})


def minima(series: DataFrame, percentile: float = 0.4, keep: int = 2, key: str = "path") -> DataFrame:
    """(key, rank, i, x): the lowest local minima of a series (key, i, x) that lie below its percentile. A minimum is lower
    than both neighbours, so a plateau has none; at the ends only one neighbour counts."""
    order = Window.partitionBy(key).orderBy("i")
    rows = series.withColumns({"before": F.lag("x").over(order), "after": F.lead("x").over(order)})
    limit = series.groupBy(key).agg(F.percentile("x", F.lit(percentile)).alias("limit"))
    low = rows.join(limit, key).where((F.col("x") < F.col("limit")) & F.coalesce(F.col("x") < F.col("before"), F.lit(True)) & F.coalesce(F.col("x") < F.col("after"), F.lit(True)))
    return low.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("x", "i"))).where(F.col("rank") <= keep).select(key, "rank", "i", "x")


def drop_time(onsets: DataFrame, after: float = 15.0, key: str = "path") -> DataFrame:
    """(key, t): when the strength of rows (key, t, strength) is highest later than some seconds, the earliest of equals;
    the highest of all where none is so late."""
    best = lambda late: F.max_by("t", F.when(late, F.struct("strength", -F.col("t"))))
    return onsets.groupBy(key).agg(F.coalesce(best(F.col("t") > after), best(F.lit(True))).alias("t"))


def first_crossing(series: DataFrame, level: float, key: str = "path") -> DataFrame:
    """(key, t): the first time at which rows (key, t, x) are above a level; the first time of all where they never are."""
    return series.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("x") > level, F.col("t"))), F.min("t")).alias("t"))
