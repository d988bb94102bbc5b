"""The k most similar vectors of every vector.

Method: an inverted file of coarse centroids with product-quantised residuals. Centroids and codebooks are fitted on a
bounded sample (`SAMPLE_PER_CELL` rows a cell, `LEAST_SAMPLE` at least, for at most `MAX_CELLS` cells); every row is indexed. A row is a member of its
nearest cell and a query in the cells whose centroids are about as near. In a cell, asymmetric distance tables of each
query score the members' codes, the best of them form a shortlist, and the shortlist is ranked again by exact cosines.

A table of more than `MAX_CELLS` times `ROWS_PER_CELL` rows gets a second level: every cell is divided by centroids of its
own, fitted in its own task on a bounded sample, so that the work of a row does not grow with the table. These centroids
stay in a table and are joined to the rows of their cell; only the first level is broadcast, at most `MAX_CELLS` vectors.

Exact copies enter a cell once per input partition at most, so a vector that a third of all rows share neither fills a
cell nor hides other neighbours; the copies come back at the end. A cell that the sample shows to be large is cut into a
grid: blocks of its members meet parts of its queries, and no task holds more than a block of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewave.llm import vectors as V
from cratewave.storage import materialize

ROWS_PER_CELL = 200
MAX_CELLS = 4096
SAMPLE_PER_CELL, LEAST_SAMPLE = 24, 16_384
MARGIN, MOST_PROBES = 0.1, 4
PARTS, WORDS = 16, 256
SHORTLIST = 400
#: Parts of a cell of the first level at most, and sample rows that they are fitted on at most.
MAX_PARTS, PART_SAMPLE = 1024, 24_576
#: Members up to which a cell is one task.
CELL_ROWS = 6000


@dataclass
class Index:
    """Coarse centroids, codebooks (part, word, dimension), the rows expected in each cell, and into how many blocks of
    members and parts of queries it is cut."""

    centroids: np.ndarray
    books: np.ndarray
    expected: np.ndarray
    grid: np.ndarray

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        parts, words, width = self.books.shape
        codes = np.empty((len(residuals), parts), np.uint8)
        for p in range(parts):
            block = residuals[:, p * width : (p + 1) * width]
            codes[:, p] = (block @ self.books[p].T - 0.5 * (self.books[p] ** 2).sum(axis=1)).argmax(axis=1)
        return codes


def fit(x: np.ndarray, total: int, *, rows_per_cell: int = ROWS_PER_CELL, max_cells: int = MAX_CELLS, cell_rows: int = CELL_ROWS, parts: int = PARTS, words: int = WORDS) -> Index:
    """An index fitted on unit sample rows of a table of `total` rows."""
    cells = int(min(max_cells, max(1, total // rows_per_cell), max(1, len(x) // 4)))
    centroids = V.spherical_kmeans(x, cells)
    home, _ = V.nearest(x, centroids)
    residuals = x - centroids[home]
    width = x.shape[1] // parts
    rng = np.random.default_rng(11)
    books = np.zeros((parts, words, width), np.float32)
    for p in range(parts):
        block = residuals[:, p * width : (p + 1) * width]
        book = block[rng.choice(len(block), words, replace=len(block) < words)].copy()
        for _ in range(5):
            code = (block @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)
            n = np.bincount(code, minlength=words)
            sums = np.stack([np.bincount(code, block[:, d], words) for d in range(width)], axis=1)
            book[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
        books[p] = book
    expected = np.bincount(home, minlength=len(centroids)) * (total / max(len(x), 1))
    return Index(centroids, books, expected, np.maximum(1, np.ceil(expected / cell_rows)).astype(np.int64))


def search_cell(index: Index, cell: int, ids: np.ndarray, role: np.ndarray, rows: list[bytes], codes: np.ndarray, top: int, least: float, shortlist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) of the best `top` members for each query of a cell, from `least` on."""
    first: dict[bytes, int] = {}
    for i in np.argsort(ids, kind="stable"):
        first.setdefault(rows[i], i)
    same = np.array([first[r] for r in rows])
    is_member, is_query = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    is_member[same[(role & 1) > 0]] = True
    is_query[same[(role & 2) > 0]] = True
    m, q = np.flatnonzero(is_member), np.flatnonzero(is_query)
    if not len(m) or not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    x = V.unit(V.from_bytes(rows, index.centroids.shape[1]))
    parts, words, width = index.books.shape
    code = codes[m]
    out_q, out_m, out_c = [], [], []
    for s in range(0, len(q), 512):
        own = q[s : s + 512]
        xq = x[own]
        # asymmetric distance tables: the exact query against every word of every part, then sums over the members' codes
        tables = np.einsum("qpd,pwd->pwq", xq.reshape(len(own), parts, width), index.books, optimize=True)
        score = np.broadcast_to(xq @ index.centroids[cell], (len(m), len(own))).copy()
        for p in range(parts):
            score += tables[p][code[:, p]]
        score = np.ascontiguousarray(score.T)
        score[m[None, :] == own[:, None]] = -2
        keep = score >= least - 0.12
        if len(m) > shortlist:
            cut = np.partition(score, len(m) - shortlist, axis=1)[:, len(m) - shortlist]
            keep &= score >= cut[:, None]
        columns = np.flatnonzero(keep.any(axis=0))
        if not len(columns):
            continue
        # exact ranking of the shortlist
        exact = np.where(keep[:, columns], xq @ x[m[columns]].T, -2)
        some = min(top, len(columns))
        # all that rounding leaves level with the last one: the order of equal cosines is told in double precision
        cut = np.partition(exact, len(columns) - some, axis=1)[:, len(columns) - some] - 1e-5
        r, k = np.nonzero(exact >= np.maximum(cut, least - 1e-5)[:, None])
        a, b = own[r], m[columns[k]]
        xa, xb = x[a].astype(np.float64), x[b].astype(np.float64)
        cos = np.einsum("ij,ij->i", xa, xb) / np.sqrt(np.einsum("ij,ij->i", xa, xa) * np.einsum("ij,ij->i", xb, xb))
        order = np.lexsort((ids[b], -cos, r))
        order = order[cos[order] >= least]
        rank = np.arange(len(order)) - np.searchsorted(r[order], r[order])
        order = order[rank < top]
        out_q.append(ids[a[order]]), out_m.append(ids[b[order]]), out_c.append(cos[order])
    cat = lambda z, t: np.concatenate(z) if z else np.empty(0, t)
    return cat(out_q, np.int64), cat(out_m, np.int64), cat(out_c, np.float64)


def neighbours(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, least: float = 0.75, dim: int = V.DIM,
    margin: float = MARGIN, most_probes: int = MOST_PROBES, shortlist: int = SHORTLIST, rows_per_cell: int = ROWS_PER_CELL, max_cells: int = MAX_CELLS,
    cell_rows: int = CELL_ROWS, exact: bool = False,
) -> DataFrame:
    """(`key`, neighbour, cosine): up to `k` others of highest cosine, from `least` on, ties by smaller key. With `exact`
    every row is compared with all rows, by the blocks of all cells and without a shortlist: quadratic work, but nothing
    is left out.

    Vectors that are null, of another length, not finite or all zero are neither queries nor neighbours; an empty table
    gives no rows. Keys are bigint and unique. Other columns are dropped.
    """
    spark = df.sparkSession
    df = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    total = df.count()
    x = V.sample(df, "v", max(LEAST_SAMPLE, SAMPLE_PER_CELL * min(max_cells, total // rows_per_cell)), total, dim)
    if not len(x):
        return spark.createDataFrame([], f"{key} bigint, neighbour bigint, cosine double")
    fitted = fit(x, total, rows_per_cell=rows_per_cell, max_cells=max_cells, cell_rows=cell_rows, parts=min(PARTS, dim))
    shared = spark.sparkContext.broadcast(fitted)
    deep = total // rows_per_cell > 2 * max_cells and not exact
    if exact:
        margin, most_probes, shortlist = 4.0, len(fitted.centroids), max(total, 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            at, raw = V.finite(batch, "v", dim)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[at]
            data = V.to_bytes(raw)
            new = V.unseen(data, seen)
            if not new:
                continue
            ids, unit, data = ids[new], V.unit(raw[new]), [data[i] for i in new]
            row, cell, rank = V.probes(unit, index.centroids, margin, most_probes)
            home = cell[rank == 0]  # in order of the rows
            codes = index.encode(unit - index.centroids[home])
            # place (block of members, part of queries): a member goes along its row of the grid, a query along its column
            n = np.ones_like(cell) if deep else index.grid[cell]
            block = np.array([int.from_bytes(hashlib.blake2b(d, digest_size=4).digest(), "little") for d in data], np.int64)[row] % n
            copies = np.where(rank == 0, 2 * n - 1, n)
            row_, cell_, rank_, block_, n_ = (np.repeat(z, copies) for z in (row, cell, rank, block, n))
            nth = np.arange(len(row_)) - np.repeat(np.cumsum(copies) - copies, copies)
            along = nth < n_  # the column of the query; then the rest of the row of the member
            other = nth - n_ + (nth - n_ >= block_)
            salt = np.where(along, nth * n_ + block_, block_ * n_ + other)
            role = np.where((rank_ == 0) & (~along | (nth == block_)), 1, 0) | np.where(along, 2, 0)
            index_ = pa.array(row_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell_.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(ids[row_]), pa.array(role.astype(np.int8)),
                 pa.array(data, pa.binary()).take(index_), pa.array([c.tobytes() for c in codes], pa.binary()).take(index_)],
                ["cell", "salt", "id", "role", "v", "code"],
            )

    def search(group: pa.Table) -> pa.Table:
        index: Index = shared.value
        codes = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(len(group), -1)
        q, n, c = search_cell(index, group["cell"][0].as_py(), group["id"].to_numpy(), group["role"].to_numpy(), group["v"].to_pylist(), codes, k + 1, least, shortlist)
        return pa.table([pa.array(q), pa.array(n), pa.array(c)], ["q", "n", "cosine"])

    placed = df.mapInArrow(assign, "cell int, salt int, id bigint, role tinyint, v binary, code binary")
    if deep:
        placed = _divided(df, placed, shared, fitted, dim, rows_per_cell, cell_rows, margin, most_probes)
    found = materialize(  # read by two branches below
        placed.groupBy("cell", "salt").applyInArrow(search, "q bigint, n bigint, cosine double"), "found",
    )
    members, groups = V.copies(df, "id", "v", k + 1, dim)
    members, groups = materialize(members, "members"), materialize(groups, "groups")
    several = members.join(groups, ["k1", "k2"]).select("id", "k1", "k2", "ids")
    wide = (
        found.join(several.select(F.col("id").alias("n"), "ids"), "n", "left")
        .select("q", F.explode(F.coalesce("ids", F.array("n"))).alias("n"), "cosine")
        .join(several.select(F.col("id").alias("q"), "k1", "k2"), "q", "left")
    )
    best = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cosine"), "n"))
    single = wide.where("k1 is null").withColumn("r", best(["q"])).where(F.col("r") <= k)
    # the list of a group of copies, its own rows first, goes to each of them
    own = groups.select("k1", "k2", F.explode("ids").alias("n"), F.lit(1.0).alias("cosine"))
    shared_lists = (
        wide.where("k1 is not null").select("k1", "k2", "n", "cosine").unionByName(own)
        .withColumn("r", best(["k1", "k2"])).where(F.col("r") <= k + 1).drop("r")
    )
    copied = (
        members.withColumnRenamed("id", "q").join(shared_lists, ["k1", "k2"]).where("q <> n")
        .withColumn("r", best(["q"])).where(F.col("r") <= k)
    )
    columns = [F.col("q").alias(key), F.col("n").alias("neighbour"), "cosine"]
    return single.select(*columns).unionByName(copied.select(*columns))


def _divided(df: DataFrame, placed: DataFrame, shared: Broadcast, index: Index, dim: int, rows_per_cell: int, cell_rows: int, margin: float, most_probes: int) -> DataFrame:
    """`placed` rows of cells with their part of the cell as `salt`: a member goes to the nearest centroid of its cell, a
    query to those about as near. A cell has a part for every `rows_per_cell` rows that are expected in it."""
    spark = df.sparkSession

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        share = np.minimum(1.0, PART_SAMPLE / np.maximum(own.expected, 1))
        for batch in batches:
            _, raw = V.finite(batch, "v", dim)
            if len(raw):
                data = V.to_bytes(raw)
                cell, _ = V.nearest(V.unit(raw), own.centroids)
                chance = np.array([int.from_bytes(hashlib.blake2b(d, digest_size=4, salt=b"draw").digest(), "little") for d in data]) / 2**32
                at = np.flatnonzero(chance < share[cell])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at].astype(np.int32)), pa.array([data[i] for i in at], pa.binary())], ["cell", "v"])

    def centroids(group: pa.Table) -> pa.Table:
        own: Index = shared.value
        cell = group["cell"].slice(0, 1)
        parts = int(min(MAX_PARTS, max(1, np.ceil(own.expected[cell[0].as_py()] / rows_per_cell))))
        x = V.unit(V.from_bytes(sorted(group["v"].to_pylist()), dim))
        return pa.table([cell, pa.array([V.spherical_kmeans(x, min(parts, max(1, len(x) // 4))).astype(np.float32).tobytes()], pa.binary())], ["cell", "centroids"])

    def route(rows: pa.Table, level: pa.Table) -> pa.Table:
        if not len(rows):
            return rows.select(["cell", "salt", "id", "role", "v", "code"])
        if not len(level):
            return rows.select(["cell", "salt", "id", "role", "v", "code"])
        c = np.frombuffer(level["centroids"][0].as_py(), np.float32).reshape(-1, dim)
        member = rows["role"].to_numpy() & 1 > 0
        r, part, rank = V.probes(V.unit(V.from_bytes(rows["v"].to_pylist(), dim)), c, margin, most_probes)
        role = np.where((rank == 0) & member[r], 3, 2).astype(np.int8)
        at = pa.array(r)
        return pa.table([rows["cell"].take(at), pa.array(part.astype(np.int32)), rows["id"].take(at), pa.array(role), rows["v"].take(at), rows["code"].take(at)], ["cell", "salt", "id", "role", "v", "code"])

    level = materialize(df.mapInArrow(drawn, "cell int, v binary").groupBy("cell").applyInArrow(centroids, "cell int, centroids binary"), "level")
    # rows of one cell in bounded blocks, each with the centroids of the cell; the number of blocks is a table of the cells
    blocks = spark.createDataFrame([(c, int(n)) for c, n in enumerate(np.maximum(1, np.ceil(index.expected / cell_rows)))], "cell int, blocks int")
    left = placed.drop("salt").join(F.broadcast(blocks), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    right = level.join(F.broadcast(blocks), "cell").select("cell", "centroids", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(route, "cell int, salt int, id bigint, role tinyint, v binary, code binary")


def pairs(lists: DataFrame, key: str = "vec_id") -> DataFrame:
    """(a, b), a < b, each pair once that is in the list of at least one of the two."""
    return lists.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")).distinct()
