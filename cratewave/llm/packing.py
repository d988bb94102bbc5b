"""Filling containers of fixed capacity with documents measured in tokens.

Method: length-histogram planning. Only the counts per length go to the driver (at most `capacity` rows per limit, so
their number is bounded by the limits and not by the corpus). Best-fit decreasing runs over these counts: containers of
equal residual form a class, and a whole run of items of one length is placed into a class at once. The plan is a list
of slots per length; documents take them by their rank within the length. The rank is counted per salted bucket plus
the bucket's offset, so a length that a third of all documents share is ranked by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the documents of one length are ranked at least, and documents for which there is one more.
SALTS, SALT_ROWS = 64, 1_000_000
#: Most limits and largest capacity that a plan is made for on the driver, and most runs of slots (48 bytes each) of all
#: plans together, which all tasks are sent. More of any is an error.
MAX_LIMITS, MAX_CAPACITY, MAX_RUNS = 1_000, 4_000_000, 2_000_000


def plan(capacity: int, counts: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Entries (length, first rank, containers, items in each, first container, offset
    in each) and the number of containers."""
    entries: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    residuals: list[int] = []
    opened = 0

    def give(residual: int, first: int, n: int) -> None:
        if residual > 0 and n > 0:
            if residual not in open_:
                open_[residual] = []
                insort(residuals, residual)
            open_[residual].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            at = bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                first, n = open_[residual].pop()
                if not open_[residual]:
                    del open_[residual]
                    residuals.pop(at)
            else:
                residual, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = residual // length
            used = min(n, left // each)
            if used:
                entries.append((length, rank, used, each, first, capacity - residual))
                give(residual - used_room(each, length), first, used)
            else:
                each, used = left, 1
                entries.append((length, rank, 1, each, first, capacity - residual))
                give(residual - used_room(each, length), first, 1)
            give(residual, first + used, n - used)
            rank += used * each
            left -= used * each
    return entries, opened


def used_room(items: int, length: int) -> int:
    """Room that some items of one length take."""
    return items * length


def pack(sizes: DataFrame, limits: list[tuple[int, int]], *, key: str = "doc_id", size: str = "n_tokens", salts: int | None = None) -> DataFrame:
    """Placement of every document in a container of every limit (`limit_id`, capacity).

    Columns: limit_id, container_id, key, piece, token_start, n_tokens, container_offset. A document within the
    capacity has one row (piece 0); a longer one is cut into full pieces and a rest, in order of token_start. Null and
    zero sizes are not placed, limits without a positive capacity hold nothing, one above
    `MAX_CAPACITY`, or plans of more than `MAX_RUNS`, are an error. `sizes` is read three times and should
    be a written table; `key` must be unique, else repeated rows are placed one by one.
    """
    spark = sizes.sparkSession
    limits = [(int(i), int(c)) for i, c in limits if i is not None and c is not None and c > 0]
    if any(c > MAX_CAPACITY for _, c in limits):
        raise ValueError(f"a capacity above {MAX_CAPACITY}")
    if len(limits) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    key_type = sizes.schema[key].dataType.simpleString()
    schema = f"limit_id int, container_id bigint, {key} {key_type}, piece int, token_start int, n_tokens int, container_offset int"
    if not limits:
        return spark.createDataFrame([], schema)
    salts = salts or SALTS + sizes.count() // SALT_ROWS
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).alias("cap")) for i, c in limits]))
    items = (
        sizes.where(F.col(size) > 0).select(F.col(key).alias("k"), F.col(size).cast("int").alias("n"), each.alias("l"))
        .select("k", "n", "l.limit_id", "l.cap", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div l.cap").cast("int"))).alias("piece"))
        .select("k", "limit_id", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.least("cap", F.col("n") - F.col("piece") * F.col("cap")).alias("len"))
        .withColumn("salt", F.pmod(F.xxhash64("k", "piece"), F.lit(salts)).cast("int"))
    )
    salted = items.groupBy("limit_id", "len", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("limit_id", "len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts: dict[int, dict[int, int]] = {i: {} for i, _ in limits}
    for row in salted.groupBy("limit_id", "len").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.limit_id][row.len] = row.n
    plans, runs = {}, 0
    for i, c in limits:
        entries, _ = plan(c, counts[i])
        by: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        for e in entries:
            by.setdefault(e[0], []).append(e)
        plans[i] = {length: np.array(es, dtype=np.int64) for length, es in by.items()}
        runs += len(entries)
        if runs > MAX_RUNS:
            raise ValueError(f"plans of more than {MAX_RUNS} runs of slots")
    shared = spark.sparkContext.broadcast(plans)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        for b in batches:
            limit, length, rank = (b.column(x).to_numpy() for x in ("limit_id", "len", "rank"))
            container, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)
            group = limit.astype(np.int64) * (MAX_CAPACITY + 1) + length
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=group[order][:1] - 1)) if len(order) else []
            for s, e in zip(edges, [*edges[1:], len(order)]):
                own = order[s:e]
                entries = plans[int(limit[own[0]])][int(length[own[0]])]
                at = entries[np.searchsorted(entries[:, 1], rank[own], "right") - 1]
                inside = rank[own] - at[:, 1]
                container[own] = at[:, 4] + inside // at[:, 3]
                offset[own] = at[:, 5] + (inside % at[:, 3]) * length[own]
            yield pa.RecordBatch.from_arrays(
                [b.column("limit_id"), pa.array(container), b.column("k"), b.column("piece"), b.column("start"), b.column("len"), pa.array(offset)],
                ["limit_id", "container_id", key, "piece", "token_start", "n_tokens", "container_offset"],
            )

    within = Window.partitionBy("limit_id", "len", "salt").orderBy("k", "piece")
    ranked = (
        items.withColumn("r", F.row_number().over(within) - 1)
        .join(offsets.drop("n"), ["limit_id", "len", "salt"])
        .select("limit_id", "k", "piece", "start", "len", (F.col("r") + F.col("before")).cast("bigint").alias("rank"))
    )
    return ranked.mapInArrow(place, schema)


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens and the share of the room that is used."""
    return (
        packed.groupBy("limit_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
        .join(limits.select("limit_id", "capacity"), "limit_id")
        .select("limit_id", "capacity", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("filled"))
    )
