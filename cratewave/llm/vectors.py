"""What the vector operators share: usable vectors as numpy matrices, exact copies, coarse centroids."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 128


def finite(batch: pa.RecordBatch, column: str, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float32 matrix of the usable rows of a batch: the right length, all elements finite, not all zero."""
    lists = batch.column(column)
    at = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = lists.take(pa.array(at)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)  # null elements become NaN
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def to_bytes(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(axis=1)
    return [h.tobytes() if e else v.tobytes() for h, v, e in zip(half, x, exact)]


def from_bytes(rows: list[bytes], dim: int = DIM) -> np.ndarray:
    """float32 matrix of rows written by `to_bytes`."""
    if not rows:
        return np.empty((0, dim), np.float32)
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), np.float16).reshape(-1, dim).astype(np.float32)
    return np.stack([np.frombuffer(r, np.float16 if len(r) == 2 * dim else np.float32).astype(np.float32) for r in rows])


def unseen(rows: list[bytes], seen: set[bytes]) -> list[int]:
    """Positions of the rows that are not yet in `seen` (digests), which they are added to."""
    new = []
    for i, row in enumerate(rows):
        digest = hashlib.blake2b(row, digest_size=16).digest()
        if digest not in seen:
            seen.add(digest)
            new.append(i)
    return new


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest element first, so that nothing overflows."""
    x = x.astype(np.float32) / np.abs(x).max(axis=1, keepdims=True).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def copy_key(column: str) -> list[Column]:
    """Two 64-bit hashes of a vector; equal vectors are told by both."""
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(7), F.col(column)).alias("k2")]


def sample(df: DataFrame, column: str, rows: int, total: int, dim: int = DIM) -> np.ndarray:
    """Unit vectors of at most about `rows` usable rows, chosen by a hash of the vector, in the order of their bytes."""
    share = min(1.0, 1.1 * rows / max(total, 1))
    chosen = df.where(F.size(column) == dim).where(F.pmod(F.xxhash64(column), F.lit(1_000_000)) < int(share * 1_000_000)).select(column)

    def run(batches):
        for b in batches:
            _, x = finite(b, column, dim)
            yield pa.RecordBatch.from_arrays([pa.array(to_bytes(x), pa.binary())], ["v"])

    got = sorted(chosen.mapInArrow(run, "v binary").limit(2 * rows).toArrow().column("v").to_pylist())  # alike however the rows lie
    return unit(from_bytes(got, dim)) if got else np.empty((0, dim), np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; empty ones are put on the worst fitting rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, sim = nearest(x, c)
        sums = np.zeros_like(c)
        order = np.argsort(best, kind="stable")
        edges = np.flatnonzero(np.diff(best[order], prepend=-1))
        sums[best[order][edges]] = np.add.reduceat(x[order], edges, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-9
        c[~empty] = sums[~empty] / norm[~empty, None]
        if empty.any():
            c[empty] = x[np.argsort(sim)[: empty.sum()]]
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index and cosine of the nearest centroid of each row."""
    best, sim = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for s in range(0, len(x), block):
        d = x[s : s + block] @ c.T
        best[s : s + block] = d.argmax(axis=1)
        sim[s : s + block] = d[np.arange(len(d)), best[s : s + block]]
    return best, sim


def probes(x: np.ndarray, c: np.ndarray, margin: float, most: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, rank) of the cells of each row: its nearest, and up to `most` - 1 others within `margin` of it."""
    rows, cells, ranks = [], [], []
    most = min(most, len(c))
    for s in range(0, len(x), block):
        d = x[s : s + block] @ c.T
        top = np.argpartition(-d, most - 1, axis=1)[:, :most]
        sims = np.take_along_axis(d, top, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        top, sims = np.take_along_axis(top, order, axis=1), np.take_along_axis(sims, order, axis=1)
        r, p = np.nonzero(sims >= sims[:, :1] - margin)
        rows.append(r + s), cells.append(top[r, p]), ranks.append(p)
    cat = lambda z: np.concatenate(z) if z else np.empty(0, np.int64)
    return cat(rows), cat(cells), cat(ranks)


def usable(column: str, dim: int = DIM) -> Column:
    """Whether a vector has `dim` elements, all finite, not all zero; false for null."""
    c = F.col(column)
    inf = F.lit(float("inf"))
    high, low = F.array_max(c), F.array_min(c)  # NaN is the largest value
    good = (F.size(c) == dim) & (F.size(F.array_compact(c)) == dim) & (high < inf) & (low > -inf) & ((high != 0) | (low != 0))
    return F.coalesce(good, F.lit(False))


def copies(df: DataFrame, key: str, column: str, keep: int, dim: int = DIM, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """Groups of equal usable vectors: (`key`, k1, k2) of every row of a group of at least two, and (k1, k2, ids) with
    the `keep` smallest keys of each group. A group is cut down in salted parts first, so a hot one needs no large task."""
    from pyspark.sql import Window

    hashed = df.where(usable(column, dim)).select(key, *copy_key(column))
    several = hashed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    members = hashed.join(several, ["k1", "k2"], "left_semi")
    salted = members.withColumn("s", F.pmod(F.xxhash64(key), F.lit(salts)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2", "s").orderBy(key))).where(F.col("r") <= keep)
    least = first.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(key))).where(F.col("r") <= keep)
    return members, least.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(key)).alias("ids"))
