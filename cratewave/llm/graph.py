"""Connected components of a graph given as pairs, in one task where they are few, else by alternating large-star and
small-star steps; pairs within classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cratewave.storage import discard, materialize


#: Pairs up to which one task follows them (two columns of 8 MB); more go in rounds over the cluster.
ONE_TASK = 1_000_000


def lowest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the pairs, smallest node that each is connected with)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, label[end], low)  # the root takes the smaller one, and with it all that hang on it
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if ends:
        found = lowest_reached(*(np.concatenate(z) for z in zip(*ends)))
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in found], ["node", "component"])


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the pairs (a bigint, b bigint); a component is named by its smallest node.

    Null ends and loops are dropped; no pairs give no rows. Up to `ONE_TASK` pairs are followed by one task, as rounds
    cost the driver a plan of several joins each. In rounds, each is written to the shared folder, where the next one
    reads it, and only a count and a checksum reach the driver. A hub's pairs shrink to one per neighbour in every step
    and are grouped with partial aggregates and joins only.
    """
    seen = Observation()
    edges = pairs.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct()
    edges = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    if seen.get["n"] <= ONE_TASK:
        found = materialize(edges.coalesce(1).mapInArrow(_follow, "node bigint, component bigint"), "components")
        discard(edges)
        return found
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node, are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        seen = Observation()  # taken while the table is written
        gone = edges
        edges = materialize(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        state = tuple(seen.get.values())
        discard(gone)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Members of a class up to which its pairs are made in one piece.
HOT_CLASS = 4_000


def class_pairs(members: DataFrame, keys: list[str], hot: int = HOT_CLASS, size: str | None = None) -> DataFrame:
    """(a, b), a < b, of all rows (`keys`, id) of one class, whose size may be told by a column `size`. A class of more than `hot` members is cut into parts: each
    part meets a copy of the whole class in a task of its own, so no task makes all pairs of a large class."""
    if size:
        rows = members.withColumn("parts", F.ceil(F.col(size) / hot).cast("int"))
    else:
        rows = members.join(members.groupBy(*keys).agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")), keys)
    left = rows.select(*keys, F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = rows.select(*keys, F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, [*keys, "part"]).where("a < b").select("a", "b")
