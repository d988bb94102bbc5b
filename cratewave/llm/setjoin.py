"""All pairs of records whose sets of values overlap above a Jaccard threshold, within one table or between two.

Method: T-occurrence list merging. Equal sets are one class. Values are put into one global order, rare ones first, by
the counts of 65,536 hash buckets (a fixed-size broadcast; the order affects speed only). A class goes to the partitions
of the values in its prefix: two sets that are similar enough share a value there. Every partition holds inverted lists
of its classes, sorted by size, and each class probes them: for a record of n values, a partner must occur on at least
T = ceil(threshold * n) of its lists. The L longest lists are set aside, the others are merged by a heap that skips
ahead where fewer than T - L lists can meet, and survivors are looked up in the long lists by binary search. A pair is
emitted in the partition of its first common prefix value only. A partition that holds many classes is cut into blocks,
and each pair of blocks is a task of its own, so its size is bounded however many classes share a value. No candidate is
capped.

Values are compared by 64-bit hashes; two values of one pair colliding has a chance below 1e-15.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewave.llm.graph import HOT_CLASS, class_pairs
from cratewave.storage import materialize

BUCKETS = 1 << 16
PARTITION_CLASSES = 1000
BLOCK_CLASSES = 6000


def value_set(*arrays: str) -> Column:
    """The distinct values of some arrays of strings, trimmed and in lower case, without nulls and empty ones."""
    empty = F.array().cast("array<string>")
    both = F.concat(*[F.coalesce(F.col(a), empty) for a in arrays])
    clean = F.transform(both, lambda x: F.lower(F.btrim(x, F.lit(" \t\r\n"))))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def prefix_length(n: int, threshold: Fraction) -> int:
    """Values of a set of n of which a similar set of any size holds at least one, in the same prefix of its own."""
    return n - math.ceil(threshold * n) + 1


def merge(lists: list[list[int]], bounds: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    """(id, occurrences) of ids on at least `least` of the sorted lists (each within its bounds), by heap-based skipping."""
    heap = [(x[lo], i) for i, (x, (lo, hi)) in enumerate(zip(lists, bounds)) if lo < hi]
    heapq.heapify(heap)
    at = [lo for lo, _ in bounds]
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            target = top + 1
        else:
            # fewer lists meet here: take out as many as could still be missing and skip them to the next head
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for i in popped:
            at[i] = bisect_left(lists[i], target, at[i], bounds[i][1])
            if at[i] < bounds[i][1]:
                heapq.heappush(heap, (lists[i][at[i]], i))


def join_block(records: list[list[int]], threshold: Fraction, apart: tuple[list[int], ...] = (), weight: float = 0.02) -> Iterator[tuple[int, int]]:
    """Pairs (record, earlier record) of similar sets; `records` are sorted by size, `apart` holds labels of the records
    in which the two of a pair must differ."""
    num, den = threshold.numerator, threshold.denominator
    lists: dict[int, list[int]] = {}
    for i, r in enumerate(records):
        for v in r:
            lists.setdefault(v, []).append(i)
    sizes = [len(r) for r in records]
    for p in range(len(records)):
        n = sizes[p]
        least = -(-num * n // den)
        start = bisect_left(sizes, least)
        chosen = []
        for v in records[p]:
            x = lists[v]
            lo, hi = bisect_left(x, start), bisect_left(x, p)
            if lo < hi:
                chosen.append((hi - lo, x, lo, hi))
        if len(chosen) < least:
            continue
        chosen.sort(key=lambda z: z[0])
        aside = min(least - 1, int(least / (weight * math.log2(chosen[-1][0] + 1) + 1)))
        short, long = chosen[: len(chosen) - aside], chosen[len(chosen) - aside :]
        for c, count in merge([z[1] for z in short], [(z[2], z[3]) for z in short], max(1, least - aside)):
            if any(label[c] == label[p] for label in apart):
                continue
            need = -(-num * (n + sizes[c]) // (num + den))
            left = len(long)
            for _, x, lo, hi in long:
                if count >= need or count + left < need:
                    break
                left -= 1
                k = bisect_left(x, c, lo, hi)
                if k < hi and x[k] == c:
                    count += 1
            if count >= need:
                yield p, c


def similar(
    df: DataFrame, *, key: str, values: Column, threshold: str = "0.7", smallest: int = 1, other: DataFrame | None = None, other_values: Column | None = None,
    partition_classes: int = PARTITION_CLASSES, block_classes: int = BLOCK_CLASSES, hot: int = HOT_CLASS,
) -> DataFrame:
    """(a, b): pairs of rows with sets of at least `smallest` values and a Jaccard similarity of `threshold` or more.

    `values` is an array<string> without nulls or repetitions (see `value_set`); null counts as the empty set, which is
    similar to nothing. Within one table a < b; with `other`, a is of `df` and b of `other`. Keys are bigint; repeated
    keys give repeated pairs. Empty tables give no rows. Rows of a set that more than `hot` rows have are spread over
    parts, which every partner meets, so no task makes all pairs of a crowded set.
    """
    members, linked = _linked(df, key, values, threshold, smallest, other, other_values, partition_classes, block_classes)
    sized = members.withColumn("parts", F.ceil(F.col("n") / hot).cast("int"))
    crowded = sized.where("parts > 1").select("class", "side", "parts").distinct()
    side = lambda i, c, s, p: sized.select(F.col("id").alias(i), F.col("class").alias(c), F.col("side").alias(s), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias(p))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    spread = linked
    for c, s, p in (("x", "xs", "px"), ("y", "ys", "py")):
        spread = spread.join(crowded.select(F.col("class").alias(c), F.col("side").alias(s), F.col("parts").alias(p)), [c, s], "left").withColumn(p, every(p))
    expanded = spread.join(side("i", "x", "xs", "px"), ["x", "xs", "px"]).join(side("j", "y", "ys", "py"), ["y", "ys", "py"])
    if other is not None:
        pairs = expanded.select(F.when(F.col("xs") == 0, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(F.col("xs") == 0, F.col("j")).otherwise(F.col("i")).alias("b"))
        most = members.groupBy("k1", "k2").agg(F.ceil(F.max("n") / hot).cast("int").alias("parts"))
        rows = members.join(most, ["k1", "k2"])
        left = rows.where("side = 0").select("k1", "k2", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        right = rows.where("side = 1").select("k1", "k2", F.col("id").alias("b"), every("parts").alias("part"))
        return pairs.unionByName(left.join(right, ["k1", "k2", "part"]).select("a", "b"))
    pairs = expanded.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return pairs.unionByName(class_pairs(members.where("n > 1").select("class", "id", "n"), ["class"], hot, "n"))


def classes_of(df: DataFrame, *, key: str, values: Column, threshold: str = "0.7", smallest: int = 1) -> DataFrame:
    """One row per row of `df` with a similar one: `key`, `class_id` (the smallest key of all rows with its set) and `links`
    (its similar rows, those with the same set among them). Counted by classes of equal sets, without making pairs."""
    members, linked = _linked(df, key, values, threshold, smallest, None, None, PARTITION_CLASSES, BLOCK_CLASSES)
    sizes = members.select("class", "n").distinct()
    both = linked.select(F.col("x").alias("class"), F.col("y").alias("other")).unionByName(linked.select(F.col("y").alias("class"), F.col("x").alias("other")))
    more = both.join(sizes.select(F.col("class").alias("other"), F.col("n").alias("m")), "other").groupBy("class").agg(F.sum("m").alias("m"))
    rows = members.join(more, "class", "left").withColumn("links", F.col("n") - 1 + F.coalesce("m", F.lit(0)))
    return rows.where("links > 0").select(F.col("id").alias(key), F.col("class").alias("class_id"), "links")


def _linked(df: DataFrame, key: str, values: Column, threshold: str, smallest: int, other: DataFrame | None, other_values: Column | None, partition_classes: int, block_classes: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, side, k1, k2, class, n) of all sets, and pairs of similar classes (x, xs, y, ys)."""
    spark = df.sparkSession
    share = Fraction(threshold)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.lit(0).alias("side"), values.alias("s"))
    if other is not None:
        rows = rows.unionByName(other.select(F.col(key).cast("bigint").alias("id"), F.lit(1).alias("side"), (other_values if other_values is not None else values).alias("s")))
    sets = materialize(
        rows.where(F.size("s") >= max(1, smallest)).select("id", "side", F.array_sort(F.transform("s", lambda x: F.xxhash64(x))).alias("s"))
        .select("id", "side", "s", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(7), "s").alias("k2")), "sets",
    )
    classes = materialize(sets.groupBy("k1", "k2", "side").agg(F.min("id").alias("class"), F.any_value("s").alias("s"), F.count("*").alias("n")), "classes")
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in classes.select(F.explode("s").alias("v")).select(F.pmod("v", F.lit(BUCKETS)).cast("int").alias("b")).groupBy("b").count().toLocalIterator():
        counts[bucket] = n
    shared = spark.sparkContext.broadcast(counts)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = b.column("s").offsets.to_numpy(), b.column("s").values.to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            inside = flat[offsets[0] : offsets[-1]]
            order = np.lexsort((inside, shared.value[np.mod(inside, BUCKETS)], owner))
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("side"), pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(inside[order]))], ["class", "side", "s"])

    sorted_ = materialize(classes.select("class", "side", "s").mapInArrow(ordered, "class bigint, side int, s array<bigint>"), "sorted")
    n_parts = max(1, sorted_.count() * 3 // partition_classes)
    size = F.size("s")
    prefix = F.slice("s", 1, (size - F.ceil(size * F.lit(share.numerator) / F.lit(share.denominator) - F.lit(1e-9)) + 1).cast("int"))
    placed = sorted_.select("class", "side", "s", F.explode(F.array_distinct(F.transform(prefix, lambda v: F.pmod(v, F.lit(n_parts)).cast("int")))).alias("part"))
    blocks = placed.groupBy("part").count().select("part", F.ceil(F.col("count") / block_classes).cast("int").alias("blocks")).where("blocks > 1")
    blocked = (
        placed.join(blocks, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("class", "side"), F.col("blocks")).cast("int"))
        .select("part", "class", "side", "s", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        .select("part", "class", "side", "s", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    )
    between = other is not None

    def probe(group: pa.Table) -> pa.Table:
        part, two = group["part"][0].as_py(), group["i"][0].as_py() != group["j"][0].as_py()
        ids, sides, own, records = group["class"].to_pylist(), group["side"].to_pylist(), group["own"].to_pylist(), group["s"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (len(records[i]), ids[i], sides[i]))
        records = [records[i] for i in order]
        apart = tuple([label[i] for i in order] for label, needed in ((sides, between), (own, two)) if needed)
        out = []
        for p, c in join_block(records, share, apart):
            other_prefix = set(records[c][: prefix_length(len(records[c]), share)])
            first = next(v for v in records[p][: prefix_length(len(records[p]), share)] if v in other_prefix)
            if first % n_parts == part:
                out.append((order[p], order[c]))
        a, b = zip(*out) if out else ((), ())
        take = lambda z, at, t: pa.array([z[i] for i in at], t)
        return pa.table([take(ids, a, pa.int64()), take(sides, a, pa.int32()), take(ids, b, pa.int64()), take(sides, b, pa.int32())], ["x", "xs", "y", "ys"])

    linked = blocked.groupBy("part", "i", "j").applyInArrow(probe, "x bigint, xs int, y bigint, ys int")
    members = sets.join(classes.select("k1", "k2", "side", "class", "n"), ["k1", "k2", "side"]).select("id", "side", "k1", "k2", "class", "n")
    return members, linked
