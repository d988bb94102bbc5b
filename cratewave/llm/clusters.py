"""Clusters of mutually similar vectors among vectors that belong to none.

Method: bisecting k-means. The upper levels of the tree are split on a bounded sample, always the node of largest
dispersion (or one that too many rows would reach), and every row goes to its nearest leaf of this part. Subtrees of at
most about `NODE_ROWS` rows become one task each, where all their rows are split further in the same way until every
leaf is compact: each two of its members reach the similarity. Plain bisection also cuts through clusters, so leaves
whose centres are close are compared member by member and joined again where any two members reach the similarity; a
joined group is a cluster only if all of them do.

Every group of several vectors that may be reported is compared, in blocks, with all vectors of other tasks that can
reach a member by the radius of the group; nothing within the similarity is left out. What lies in one group goes as one
ball first, its vectors only where two balls allow a link, and of two such groups only those of the smaller one. Single vectors near the border of
their task are compared with each other across tasks by the cells (leaves of the upper tree) within a margin: only a
cluster of which every task holds a single member could escape there. Links between groups are followed through, and
linked groups are checked again as one, in blocks, so that no group has to fit one task. Exact copies travel once per
input partition and come back at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewave.functions.scores import exact_mean
from cratewave.llm import vectors as V
from cratewave.llm.graph import components
from cratewave.storage import materialize

ROWS_PER_CELL, MAX_CELLS = 200, 4096
SAMPLE_PER_CELL, LEAST_SAMPLE = 16, 16_384
NODE_ROWS = 12_000
MARGIN, MOST_PROBES = 0.12, 6
BLOCK = 4096
#: Groups that are sent to all tasks at once for the comparison with outsiders (half precision: 17 MB).
HUB_BLOCK = 65_536
#: Balls and groups of one matrix product, which stays in the cache; candidates of one batch.
TILE, FOUND = (512, 2048), 100_000
#: Vectors that join a group across tasks up to which they are sent to all tasks (half precision: 4 MB).
LATE = 16_384
#: Radians by which bounds on angles are widened for rounding.
ROUNDING = 2e-3


def split(x: np.ndarray, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Side (bool) of each unit row by spherical 2-means; both sides are taken, unless all rows are equal."""
    a = x[rng.integers(len(x))]
    b = x[(x @ a).argmin()]
    a = x[(x @ b).argmin()]
    side = x @ (a - b) > 0
    for _ in range(rounds):
        n = int(side.sum())
        if n in (0, len(x)):
            break
        s1 = side.astype(np.float32) @ x
        s2 = x.sum(axis=0) - s1
        new = x @ (s1 / (np.linalg.norm(s1) + 1e-12) - s2 / (np.linalg.norm(s2) + 1e-12)) > 0
        if (new == side).all():
            break
        side = new
    if side.all() or not side.any():
        side = np.arange(len(x)) < (len(x) + 1) // 2
    return side


def dispersion(x: np.ndarray) -> float:
    """Sum over unit rows of one minus the cosine with their centre."""
    return len(x) - float(np.linalg.norm(x.sum(axis=0)))


@dataclass
class Tree:
    """Centres of the leaves (cells) of the upper tree, and the task of each."""

    centres: np.ndarray
    node: np.ndarray


def grow(x: np.ndarray, total: int, *, cells: int, node_rows: int) -> Tree:
    """Upper tree on unit sample rows of a table of `total` rows."""
    rng = np.random.default_rng(5)
    scale = total / max(len(x), 1)
    heap: list[tuple[tuple[bool, float], int, np.ndarray, tuple[int, ...]]] = []
    done: list[tuple[np.ndarray, tuple[int, ...]]] = []
    seq = 0

    def push(at: np.ndarray, way: tuple[int, ...]) -> None:
        nonlocal seq
        seq += 1
        heapq.heappush(heap, ((not len(at) * scale > node_rows, -dispersion(x[at])), seq, at, way))

    push(np.arange(len(x)), ())
    while heap and len(heap) + len(done) < cells or heap and not heap[0][0][0] and len(heap) + len(done) < 2 * cells:
        _, _, at, way = heapq.heappop(heap)
        if len(at) < 4 or dispersion(x[at]) < 1e-4:
            done.append((at, way))
            continue
        side = split(x[at], rng)
        push(at[side], (*way, 0))
        push(at[~side], (*way, 1))
    leaves = done + [(at, way) for _, _, at, way in heap]
    centres = np.stack([x[at].sum(axis=0) for at, _ in leaves])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
    # the task of a leaf is its highest ancestor that few enough rows reach
    rows: dict[tuple[int, ...], float] = {}
    for at, way in leaves:
        for d in range(len(way) + 1):
            rows[way[:d]] = rows.get(way[:d], 0) + len(at) * scale
    tasks: dict[tuple[int, ...], int] = {}
    node = [tasks.setdefault(next((way[:d] for d in range(len(way)) if rows[way[:d]] <= node_rows), way), len(tasks)) for _, way in leaves]
    return Tree(centres.astype(np.float32), np.array(node))


def compact_leaves(x: np.ndarray, least: float) -> np.ndarray:
    """Leaf number of each unit row after bisecting until every two members of a leaf reach `least`."""
    rng = np.random.default_rng(3)
    label = np.empty(len(x), np.int64)
    near = np.sqrt((1 + least) / 2)  # all within this of the centre: all pairs reach `least`
    n_leaves = 0
    heap = [(-dispersion(x), 0, np.arange(len(x)))]
    seq = 0
    while heap:
        _, _, at = heapq.heappop(heap)
        own = x[at]
        leaf = singles = False
        if len(at) <= 512:
            g = own @ own.T
            leaf = bool(g.min() >= least) or len(at) == 1
            if not leaf:
                g[np.diag_indices(len(at))] = -1
                singles = bool(g.max() < least)  # every split would end in single members
        else:
            centre = own.sum(axis=0)
            leaf = bool((own @ (centre / (np.linalg.norm(centre) + 1e-12))).min() >= near)
        if leaf:
            label[at] = n_leaves
            n_leaves += 1
        elif singles:
            label[at] = n_leaves + np.arange(len(at))
            n_leaves += len(at)
        else:
            side = split(own, rng)
            for part in (at[side], at[~side]):
                seq += 1
                heapq.heappush(heap, (-dispersion(x[part]), seq, part))
    return label


def bound(radius: np.ndarray, least: float) -> np.ndarray:
    """Cosine with the centre of a group below which no member within `radius` (an angle) of it can reach `least`."""
    return np.cos(np.minimum(np.arccos(least) + radius + ROUNDING, np.pi)).astype(np.float32)


class Hubs:
    """Groups, by their centres and radii, against which the vectors of other tasks are held."""

    def __init__(self, hub: np.ndarray, home: np.ndarray, size: np.ndarray, centres: np.ndarray, radius: np.ndarray, least: float) -> None:
        """Ids of groups, their tasks, how many vectors they have, their unit centres, the angles within which these are."""
        self.hub, self.home, self.size, self.centres, self.least_of = hub, home, size, centres, bound(radius, least)
        reach = np.minimum(np.arccos(least) + radius.astype(np.float64) + ROUNDING, np.pi)
        self.widest = reach.max()
        self.balls = np.column_stack([centres, np.cos(reach), np.sin(reach)]).astype(np.float32)

    def near(self, x: np.ndarray, part: np.ndarray, node: np.ndarray, size: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of every unit row of another task that can reach a member of the group. Of two groups that are
        both held against the other's rows, only the rows of the smaller one (by size, then id) are."""
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=part[order[:1]] - 1))
        n = np.diff(np.append(first, len(order)))
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / (norm + 1e-12)
        radius = np.maximum.reduceat(np.arccos(np.clip(np.einsum("ij,ij->i", x[order], np.repeat(centres, n, axis=0)), -1, 1)), first) + ROUNDING
        # the vectors of a ball that is too wide for a bound go one by one
        wide = (radius + self.widest > np.pi) | (norm[:, 0] < 1e-3)
        cut = np.repeat(wide, n)
        cut[first] = True
        first = np.flatnonzero(cut)
        ball = np.cumsum(cut)[np.flatnonzero(np.repeat(~wide, n) & cut)] - 1
        n = np.diff(np.append(first, len(order)))
        at = order[first]
        angle, middle = np.zeros(len(first)), x[at].copy()
        several = ball[n[ball] > 1]
        of = np.flatnonzero(~wide)[n[ball] > 1]
        angle[several], middle[several] = radius[of], centres[of]
        units = np.column_stack([middle, -np.cos(angle), np.sin(angle)]).astype(np.float32)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for s in range(0, len(units), TILE[0]):
            for t in range(0, len(self.balls), TILE[1]):
                # the cosine of the centres less that of the widest angle at which a link is possible
                hit = units[s : s + TILE[0]] @ self.balls[t : t + TILE[1]].T >= -1e-6
                if not hit.any():
                    continue
                u, h = np.nonzero(hit)
                u, h = u + s, h + t
                r = at[u]
                smaller = (size[r] < self.size[h]) | (size[r] == self.size[h]) & (part[r] < self.hub[h])
                kept = (node[r] != self.home[h]) & (smaller | ~whole[r] | (size[r] == 1))  # groups of one task were compared there
                found.append((u[kept], h[kept]))
        u, h = (np.concatenate(z) for z in zip(*found))
        one = n[u] == 1
        rows, groups = [at[u[one]]], [h[one]]
        u, h = u[~one], h[~one]
        by = np.argsort(u, kind="stable")
        u, h = u[by], h[by]
        starts = np.flatnonzero(np.diff(u, prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(u)]):
            own, to = order[first[u[s]] : first[u[s]] + n[u[s]]], h[s:e]
            i, j = np.nonzero(x[own] @ self.centres[to].T >= self.least_of[to])
            rows.append(own[i]), groups.append(to[j])
        return np.concatenate(rows), np.concatenate(groups)


def rejoin(x: np.ndarray, leaf: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, whether all pairs of the group reach `least`), groups being connected by pairs that do.

    Every leaf must be compact. A row is compared with the members of a leaf wherever one of them can reach it by the
    radius of the leaf.
    """
    order = np.argsort(leaf, kind="stable")
    edges = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    sums = np.add.reduceat(x[order], edges, axis=0)
    centres = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-12)
    k = len(edges)
    label = np.arange(k)

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    sizes = np.diff(np.append(edges, len(order)))
    of_leaf = np.repeat(np.arange(k), sizes)
    radius = np.maximum.reduceat(np.arccos(np.clip(np.einsum("ij,ij->i", x[order], centres[of_leaf]), -1, 1)), edges)
    near = bound(radius, least)
    for s in range(0, len(order), 2048):
        rows = x[order[s : s + 2048]]
        r, b = np.nonzero(rows @ centres.T >= near)
        for i, j in np.unique(np.stack([of_leaf[s + r], b])[:, of_leaf[s + r] != b], axis=1).T:
            i, j = find(i), find(j)
            if i != j:
                label[max(i, j)] = min(i, j)
    rough = np.array([find(i) for i in range(k)])
    group, whole = np.arange(k), np.ones(k, bool)
    by = np.argsort(rough, kind="stable")
    starts = np.flatnonzero(np.diff(rough[by], prepend=-1))
    for s, e in zip(starts, [*starts[1:], k]):
        own = by[s:e]
        if len(own) == 1:
            continue
        rows = np.concatenate([order[edges[l] : edges[l] + sizes[l]] for l in own])
        cuts = np.cumsum(sizes[own]) - sizes[own]
        high, low = np.full((len(own), len(own)), -2, np.float32), np.full((len(own), len(own)), 2, np.float32)
        owner = np.repeat(np.arange(len(own)), sizes[own])
        members = x[rows]
        for t in range(0, len(rows), 1024):
            g = members[t : t + 1024] @ members.T
            first = np.flatnonzero(np.diff(owner[t : t + 1024], prepend=-1))
            at = owner[t : t + 1024][first]
            high[at] = np.maximum(high[at], np.maximum.reduceat(np.maximum.reduceat(g, cuts, axis=1), first, axis=0))
            low[at] = np.minimum(low[at], np.minimum.reduceat(np.minimum.reduceat(g, cuts, axis=1), first, axis=0))
        near = high >= least
        free = np.ones(len(own), bool)
        for i in range(len(own)):
            if not free[i]:
                continue
            reach = np.zeros(len(own), bool)
            reach[i] = True
            while True:
                more = near[reach].any(axis=0) | reach
                if (more == reach).all():
                    break
                reach = more
            free &= ~reach
            inside = np.flatnonzero(reach)
            group[own[inside]] = own[i]
            whole[own[inside]] = bool((low[np.ix_(inside, inside)] >= least).all()) if len(inside) > 1 else True
    of_row = np.empty(len(order), np.int64)
    of_row[order] = np.repeat(np.arange(k), sizes)
    return group[of_row], whole[of_row]


def clusters(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = 0.75, smallest: int = 6, dim: int = V.DIM,
    rows_per_cell: int = ROWS_PER_CELL, node_rows: int = NODE_ROWS, margin: float = MARGIN, most_probes: int = MOST_PROBES,
) -> DataFrame:
    """(cluster_id, `key`) of every usable vector in a cluster: a group of at least `smallest` in which every two reach
    the cosine `least`, while no other usable vector reaches it with a member. cluster_id is the smallest key.

    Vectors that are null, of another length, not finite or all zero belong to none; equal vectors count one by one; an
    empty table gives no rows. Keys are bigint and unique; other columns are dropped.
    """
    spark = df.sparkSession
    df = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    total = df.count()
    cells = max(1, min(MAX_CELLS, total // rows_per_cell))
    x = V.sample(df, "v", max(LEAST_SAMPLE, SAMPLE_PER_CELL * cells), total, dim)
    if not len(x):
        return spark.createDataFrame([], f"cluster_id bigint, {key} bigint")
    shared = spark.sparkContext.broadcast(grow(x, total, cells=min(cells, max(1, len(x) // 4)), node_rows=node_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            at, raw = V.finite(batch, "v", dim)
            ids, data = batch.column("id").to_numpy(zero_copy_only=False)[at], V.to_bytes(raw)
            new = V.unseen(data, seen)
            if len(new):
                cell, _ = V.nearest(V.unit(raw[new]), tree.centres)
                yield pa.RecordBatch.from_arrays([pa.array(tree.node[cell].astype(np.int32)), pa.array(ids[new]), pa.array([data[i] for i in new], pa.binary())], ["node", "id", "v"])

    def bisect(group: pa.Table) -> pa.Table:
        tree: Tree = shared.value
        group = group.sort_by("id")
        rows = group["v"].to_pylist()
        first: dict[bytes, int] = {}
        for i, r in enumerate(rows):
            first.setdefault(r, i)
        at = np.array(sorted(first.values()))
        ids = group["id"].to_numpy()[at]
        rows = [rows[i] for i in at]
        x = V.unit(V.from_bytes(rows, dim))
        label, whole = rejoin(x, compact_leaves(x, least), least)
        names, inverse = np.unique(label, return_inverse=True)
        lowest = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(lowest, inverse, ids)
        n = np.bincount(inverse)
        # a single vector is open if it has a cell of another task within the margin
        single = np.flatnonzero(n[inverse] == 1)
        r, c, rank = V.probes(x[single], tree.centres, margin, most_probes)
        home = tree.node[c[rank == 0]]
        open_ = np.zeros(len(x), bool)
        open_[single[r[tree.node[c] != home[r]]]] = True
        # the first row of a whole group of several has its centre, in half precision, and the radius about it
        sums = np.zeros((len(names), dim), np.float32)
        np.add.at(sums, inverse, x)
        centres = V.unit((sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-12)).astype(np.float16))
        radius = np.zeros(len(names), np.float32)
        np.maximum.at(radius, inverse, np.arccos(np.clip(np.einsum("ij,ij->i", x, centres[inverse]), -1, 1)))
        first = (ids == lowest[inverse]) & whole & (n[inverse] > 1)
        return pa.table(
            [
                pa.array(lowest[inverse]), pa.array(ids), pa.array(whole), pa.array(open_), pa.array(rows, pa.binary()), pa.array(n[inverse]),
                pa.array([centres[g].astype(np.float16).tobytes() if f else None for g, f in zip(inverse, first)], pa.binary()), pa.array(radius[inverse], pa.float32()),
            ],
            ["part", "id", "whole", "open", "v", "n", "centre", "radius"],
        ).append_column("node", group["node"].slice(0, len(ids))).sort_by("part")  # groups lie together

    parts = materialize(
        df.mapInArrow(route, "node int, id bigint, v binary").groupBy("node")
        .applyInArrow(bisect, "part bigint, id bigint, whole boolean, open boolean, v binary, n bigint, centre binary, radius float, node int"), "parts",
    )

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for batch in batches:
            rows = batch.column("v").to_pylist()
            if rows:
                r, c, _ = V.probes(V.unit(V.from_bytes(rows, dim)), tree.centres, margin, most_probes)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), batch.column("part").take(pa.array(r)), batch.column("v").take(pa.array(r))], ["cell", "part", "v"])

    def link(group: pa.Table) -> pa.Table:
        part, x = group["part"].to_numpy(), V.unit(V.from_bytes(group["v"].to_pylist(), dim))
        found: set[tuple[int, int]] = set()
        for s in range(0, len(x), 1024):
            i, j = np.nonzero((x[s : s + 1024] @ x.T >= least) & (part[s : s + 1024, None] < part[None, :]))
            found |= set(zip(part[i + s].tolist(), part[j].tolist()))
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # groups of several vectors are compared with all others below
    near = parts.where("open and n = 1").select("part", "v").mapInArrow(to_cells, "cell int, part bigint, v binary")
    links = near.groupBy("cell").applyInArrow(link, "a bigint, b bigint")

    def touch(outside: pa.Table, members: pa.Table) -> pa.Table:
        found: set[int] = set()
        if len(outside) and len(members):
            y, x = (V.unit(V.from_bytes(t["v"].to_pylist(), dim)) for t in (outside, members))
            part, hub = outside["part"].to_numpy(), outside["hub"][0].as_py()
            for s in range(0, len(y), 512):
                found |= set(part[s : s + 512][(y[s : s + 512] @ x.T >= least).any(axis=1)].tolist())
        pairs = [(min(p, hub), max(p, hub)) for p in sorted(found)]
        return pa.table([pa.array([p for p, _ in pairs], pa.int64()), pa.array([q for _, q in pairs], pa.int64())], ["a", "b"])

    def near_hubs(block: DataFrame) -> DataFrame:
        """(hub, part, v) of the rows of other tasks that can reach a group of a block, which goes to all tasks."""
        few = block.select("hub", "home", "n", "centre", "radius").toArrow()
        sent = spark.sparkContext.broadcast((*(few[c].to_numpy() for c in ("hub", "home", "n", "radius")), few["centre"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, home, size, radius, rows = sent.value
            hubs = Hubs(hub, home, size, V.unit(V.from_bytes(rows, dim)), radius, least) if rows else None
            for batch in batches:
                if len(batch) and hubs:
                    x = V.unit(V.from_bytes(batch.column("v").to_pylist(), dim))
                    at, to = hubs.near(x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "node", "n", "whole")))
                    for s in range(0, len(at), FOUND):
                        some = pa.array(at[s : s + FOUND])
                        yield pa.RecordBatch.from_arrays([pa.array(hub[to[s : s + FOUND]]), batch.column("part").take(some), batch.column("v").take(some)], ["hub", "part", "v"])

        # larger groups have these among their own outsiders
        rows = parts.where(~F.col("whole") | (F.col("n") == 1) | (F.col("n") <= max(few["n"].to_pylist(), default=0)))
        found = materialize(rows.select("part", "node", "n", "whole", "v").mapInArrow(run, "hub bigint, part bigint, v binary"), "could")
        sent.destroy()
        return found

    def outsiders(hubs: DataFrame, n_hubs: int) -> DataFrame:
        """(a, b) of groups (hub, centre, radius) and the groups of all vectors that reach one of their members."""
        blocks = -(-n_hubs // HUB_BLOCK)
        if not blocks:
            return spark.createDataFrame([], "a bigint, b bigint")
        if blocks > 1:  # the largest groups first: many rows are compared with these only
            hubs = materialize(hubs.repartitionByRange(blocks, F.desc("n"), "hub").withColumn("block", F.spark_partition_id()), "blocks")
        could = reduce(DataFrame.unionByName, [near_hubs(hubs.where(F.col("block") == k) if blocks > 1 else hubs) for k in range(blocks)])
        members = parts.select(F.col("part").alias("hub"), "v").join(could.select("hub").distinct(), "hub", "left_semi")
        return could.groupBy("hub").cogroup(members.groupBy("hub")).applyInArrow(touch, "a bigint, b bigint")

    def reached(hubs: DataFrame) -> DataFrame:
        """`outsiders` of a few single vectors, which go to all tasks instead."""
        few = hubs.select("hub", "home", "centre").limit(LATE).toArrow()
        sent = spark.sparkContext.broadcast((few["hub"].to_numpy(), few["home"].to_numpy(), few["centre"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, home, rows = sent.value
            centres = V.unit(V.from_bytes(rows, dim))
            for batch in batches:
                found: set[tuple[int, int]] = set()
                part, node = batch.column("part").to_numpy(), batch.column("node").to_numpy()
                x = V.unit(V.from_bytes(batch.column("v").to_pylist(), dim)) if len(part) else np.empty((0, dim), np.float32)
                for s in range(0, len(x), 1024):
                    i, j = np.nonzero(x[s : s + 1024] @ centres.T >= least)
                    other = node[i + s] != home[j]
                    found |= {(min(p, h), max(p, h)) for p, h in zip(part[i[other] + s].tolist(), hub[j[other]].tolist())}
                a, b = zip(*sorted(found)) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        # a whole group of several has found the single vectors that reach it
        return parts.where("n = 1 or not whole").select("part", "node", "v").mapInArrow(run, "a bigint, b bigint")

    def lowest(group: pa.Table) -> pa.Table:
        x, own = V.unit(V.from_bytes(group["v"].to_pylist(), dim)), group["own"].to_numpy()
        a, b = x[own == group["i"][0].as_py()], x[own == group["j"][0].as_py()]
        low = min((float((a[s : s + 512] @ b.T).min()) for s in range(0, len(a), 512)), default=1.0) if len(b) else 1.0
        return pa.table([group["component"].slice(0, 1), pa.array([low])], ["component", "low"])

    def joined_by(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(node, component) of the linked parts only, their rows, and the components in which every two reach `least`."""
        joined = components(links)
        linked = parts.select("part", "id", "n", "whole").join(joined.withColumnRenamed("node", "part"), "part")
        sizes = linked.groupBy("component").agg(F.count("*").alias("rows"), F.min("whole").alias("all_whole")).where("all_whole")
        blocked = (
            parts.select("part", "id", "v").join(joined.withColumnRenamed("node", "part").join(sizes.select("component", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "component"), "part")
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .select("component", "own", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("component", "own", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        )
        good = blocked.groupBy("component", "i", "j").applyInArrow(lowest, "component bigint, low double").groupBy("component").agg(F.min("low").alias("low")).where(F.col("low") >= least)
        return joined, linked, materialize(good.select("component"), "good")

    members, _ = V.copies(df, "id", "v", 1, dim)
    members = materialize(members, "copies")
    # single vectors may be reported for their copies
    single = parts.where("n = 1").select("id", F.col("part").alias("hub"), F.col("node").alias("home"), F.col("v").alias("centre"), "radius", "n")
    hubs = parts.where("centre is not null").select(F.col("part").alias("hub"), F.col("node").alias("home"), "centre", "radius", "n").unionByName(single.join(members.select("id").distinct(), "id", "left_semi").drop("id"))
    hubs = materialize(hubs, "hubs")
    links = materialize(links.unionByName(outsiders(hubs, hubs.count())).distinct(), "links")
    joined, linked, good = joined_by(links)
    # single vectors that have come to a group across tasks may be reached in their turn
    late = materialize(single.join(linked.join(good, "component", "left_semi").where("n = 1").select("id"), "id", "left_semi").join(hubs.select("hub"), "hub", "left_anti").drop("id"), "late")
    n_late = late.count()
    if n_late:
        links = materialize(links.unionByName(reached(late) if n_late <= LATE else outsiders(late, n_late)).distinct(), "links")
        joined, linked, good = joined_by(links)
    whole = parts.where("whole").select("part", "id")
    alone = whole.join(joined.select(F.col("node").alias("part")), "part", "left_anti")
    together = linked.join(good, "component", "left_semi").select(F.col("component").alias("part"), "id")
    grouped = alone.unionByName(together).join(members, "id", "left")
    others = members.withColumnRenamed("id", "copy")
    full = grouped.where("k1 is null").select("part", "id").unionByName(
        grouped.where("k1 is not null").select("part", "k1", "k2").join(others, ["k1", "k2"]).select("part", F.col("copy").alias("id"))
    )
    kept = full.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("cluster_id")).where(F.col("n") >= smallest)
    return full.join(kept, "part").select("cluster_id", F.col("id").alias(key))


def describe(found: DataFrame, df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", typical: int = 5, dim: int = V.DIM) -> DataFrame:
    """Per cluster: its size, the `typical` members nearest to its centre (ties by smaller key), and their mean cosine
    with the centre (both of six decimals). Sums are built per input partition first, so a large cluster is never one
    task."""
    from pyspark.sql import Window

    rows = found.join(df.select(key, vector), key).select("cluster_id", F.col(key).alias("id"), F.col(vector).alias("v"))
    rows = materialize(rows, "described")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw = V.finite(b, "v", dim)
            names, inverse = np.unique(b.column("cluster_id").to_numpy()[at], return_inverse=True)
            sums = np.zeros((len(names), dim))
            np.add.at(sums, inverse, raw / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(sums), pa.list_(pa.float64()))], ["cluster_id", "s"])

    total = F.aggregate("s", F.lit(0.0), lambda a, y: a + y * y)
    centres = (
        rows.mapInArrow(partial, "cluster_id bigint, s array<double>").select("cluster_id", F.posexplode("s").alias("p", "y"))
        .groupBy("cluster_id", "p").agg(F.sum("y").alias("y")).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("p", "y"))).alias("s"))
        .select("cluster_id", F.col("s.y").alias("s")).withColumn("norm", F.sqrt(total))
    )
    dot = F.aggregate(F.zip_with("v", "s", lambda a, b: a * b), F.lit(0.0), lambda a, y: a + y)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y))
    scored = rows.join(centres, "cluster_id").select("cluster_id", "id", F.round(dot / (length * F.col("norm")), 6).alias("cosine"))
    rank = Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), "id")
    top = scored.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= typical).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
    size = scored.groupBy("cluster_id").agg(F.count("*").alias("size"), exact_mean(F.col("cosine")).alias("tightness"))
    return size.join(top, "cluster_id").select("cluster_id", "size", "tightness", F.col("t.id").alias("typical"))
