"""Exact nearest neighbours over a table of vectors: one seed, a mean of seeds, or a whole set of queries in blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cratewave.functions import vectors as V
from cratewave.storage import materialize

DIM = 128
#: Queries and rows of one pair of blocks at most, about: 4 and 32 MB of numbers.
BLOCK, ROW_BLOCK = 4096, 32_768


def current_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(ord, vec_id, v) of the newest usable vector of each track; of several built at once the highest vec_id."""
    good = vectors.where(V.usable(F.col("embedding"), dim) & F.col("ord").isNotNull())
    order = Window.partitionBy("ord").orderBy(F.col("built_at").desc_nulls_last(), F.desc("vec_id"))
    return good.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("ord", "vec_id", V.doubles(F.col("embedding")).alias("v"))


def index(vectors: DataFrame, tracks: DataFrame, dim: int = DIM) -> DataFrame:
    """Index rows (label, ord, path, v): positions in catalog order of the tracks with a usable vector."""
    rows = current_vectors(vectors, dim).join(tracks.select("ord", "path"), "ord")
    return number(rows, "ord").select((F.col("position") - 1).alias("label"), "ord", "path", "v")


def number(rows: DataFrame, order: str, per_part: int = 500_000) -> DataFrame:
    """`rows` with their `position` from 1 in the order of a unique bigint column. Only this column is sorted, by ranges of
    about equal numbers of rows whatever its values; counts per range are added up first, so no task sorts all rows."""
    ids = rows.select(order)
    parts = max(1, -(-ids.count() // per_part))
    ranged = materialize(ids.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # as many rows as parts
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    placed = ranged.withColumn("_r", within).join(F.broadcast(before), "_range").select(order, (F.col("_r") + F.col("_before")).alias("position"))
    return rows.join(placed, order)


def extend_index(old: DataFrame, rows: DataFrame) -> DataFrame:
    """`old` index (label, path) and rows (ord, path) that it lacks, with labels going on from its last, in their order.
    Known paths keep their label, paths that are gone stay."""
    fresh = number(rows.select("ord", "path").join(old.select("path"), "path", "left_anti"), "ord")
    start = old.agg((F.coalesce(F.max("label"), F.lit(-1)) + 1).alias("start")).first()["start"]
    return old.select("label", "path").unionByName(fresh.select((F.col("position") - 1 + start).alias("label"), "path"))


def mean_vector(vectors: DataFrame) -> list[float] | None:
    """Element-wise mean of a few vectors (column v), or None; sums are built by position before they leave the tasks."""
    rows = vectors.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).orderBy("p").limit(65_536).collect()
    return [r["x"] for r in rows] or None


def nearest_to(rows: DataFrame, vector: list[float], k: int, order: str = "ord") -> DataFrame:
    """The k rows nearest to one vector by cosine distance (`dist`), ties by `order`: one matrix product per batch, of which
    only k rows go on. Rows without a vector are left out; those of length zero come last, with NaN."""
    seed = np.asarray(vector, np.float64)
    seed = seed / np.linalg.norm(seed)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                d = 1 - x @ seed / np.linalg.norm(x, axis=1) if b.num_rows else np.empty(0)
            at = pa.array(np.lexsort((b.column(order).to_numpy(), d))[:k])
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(d).take(at)], [*b.schema.names, "dist"])

    schema = StructType([*rows.schema.fields, StructField("dist", DoubleType())])
    return rows.where("v is not null").mapInArrow(best, schema).orderBy("dist", order).limit(k)


def nearest_for_all(queries: DataFrame, rows: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """(q, ord, dist) of the k rows nearest to each query, without the query itself; ties by smaller ord.

    `queries` and `rows` have (ord, v). Both sides are cut into blocks by hash and every pair of blocks is one task: each
    row is sent once per query block and each query once per row block, nothing is collected, and only k rows per query
    and row block go on to the final ranking. The number of blocks follows the number of rows, so a task never holds more
    than one block of either.
    """
    spark = rows.sparkSession
    parts = parts or max(min(4 * spark.sparkContext.defaultParallelism, 64), -(-rows.count() // ROW_BLOCK))
    q_blocks = max(1, -(-queries.count() // BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    to_floats = lambda role: F.lit(role).alias("role")
    left = queries.select(to_floats(0), "ord", F.col("v"), block("ord", q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("rb"))
    right = rows.select(to_floats(1), "ord", F.col("v"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), block("ord", parts).alias("rb"))

    def best(group: pa.Table) -> pa.Table:
        role, ids = group["role"].to_numpy(), group["ord"].to_numpy()
        x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        q, r = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        r = r[np.argsort(ids[r], kind="stable")]
        out_q, out_r, out_d = [], [], []
        for s in range(0, len(q), 512) if len(r) else ():
            own = q[s : s + 512]
            d = 1 - x[own] @ x[r].T
            d[ids[own][:, None] == ids[r][None, :]] = np.inf
            n = min(k, len(r))
            limit = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero((d <= limit + 1e-12) & np.isfinite(d))
            out_q.append(ids[own[i]]), out_r.append(ids[r[j]]), out_d.append(d[i, j])
        cat = lambda z, t: np.concatenate(z) if z else np.empty(0, t)
        return pa.table([pa.array(cat(out_q, np.int64)), pa.array(cat(out_r, np.int64)), pa.array(cat(out_d, np.float64))], ["q", "ord", "dist"])

    found = left.unionByName(right).groupBy("qb", "rb").applyInArrow(best, "q bigint, ord bigint, dist double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("dist", 9), "ord"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def score_batches(rows: DataFrame, profiles: list[tuple[str, list[float]]], take: Callable[[np.ndarray, np.ndarray], tuple], schema: str, key: str = "ord", normalise: bool = True) -> DataFrame:
    """Rows of `schema` (its first column is the key) that `take` makes of keys and of their scores (row, profile): one
    matrix product per batch. Whatever of the scores is not wanted never leaves the batch. `take` returns the position
    of a key for each row, and the other columns. `profiles` is a vocabulary whose size the caller has checked; without
    profiles there are no rows."""
    if not profiles:
        return rows.sparkSession.createDataFrame([], schema)
    matrix = np.array([c for _, c in profiles], dtype=np.float64)
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if normalise:
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.divide(x, n, out=x.copy(), where=n > 0)
                row, *columns = take(x @ matrix.T)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), *columns], names)

    return rows.select(key, "v").mapInArrow(run, schema)
