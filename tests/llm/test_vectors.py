"""Clusters and neighbours against brute force."""

import numpy as np
import pytest

from cratewave.llm import clusters, graph, ivfpq
from cratewave.llm import vectors as V

DIM = 128


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in rows], "vec_id bigint, embedding array<float>, cluster_id string")


def made(seed=0, n_groups=14, noise=150, copies=4):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        centre = rng.normal(size=DIM)
        for _ in range(int(rng.integers(2, 40))):
            out.append(centre + 0.35 * rng.normal(size=DIM))
    out += list(rng.normal(size=(noise, DIM)))
    out += [out[5]] * copies + [2.0 * out[6]] + [rng.normal(size=DIM)] * 7  # copies, a scaled one, a group of copies only
    order = rng.permutation(len(out))
    rows = [(int(i) * 3 + 1, np.float16(out[k])) for i, k in enumerate(order)]
    bad = [None, [], [1.0] * 5, [0.0] * DIM, [float("nan")] + [1.0] * (DIM - 1), [float("inf")] * DIM]
    return rows, [*rows, *[(100_000 + i, b) for i, b in enumerate(bad)]]


def cosines(rows):
    x = np.array([np.asarray(v, np.float64) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.array([i for i, _ in rows]), np.round(x @ x.T, 9)


def true_clusters(rows, least=0.75, smallest=6):
    ids, c = cosines(rows)
    near = c >= least
    out = set()
    for i in range(len(ids)):
        group = np.flatnonzero(near[i])
        if len(group) >= smallest and near[np.ix_(group, group)].all() and all(near[j].sum() == len(group) for j in group):
            out.add((int(ids[group].min()), int(ids[i])))
    return out


def true_pairs(rows, k=5, least=0.75):
    ids, c = cosines(rows)
    out = set()
    for i in range(len(ids)):
        best = sorted((-c[i, j], ids[j]) for j in range(len(ids)) if j != i and c[i, j] >= least)[:k]
        out |= {(int(min(ids[i], j)), int(max(ids[i], j))) for _, j in best}
    return out


@pytest.mark.parametrize("node_rows", [12_000, 60])
def test_clusters(spark, node_rows):
    good, rows = made()
    found = clusters.clusters(table(spark, rows).repartition(3), rows_per_cell=10, node_rows=node_rows)
    assert {(r.cluster_id, r.vec_id) for r in found.collect()} == true_clusters(good)


def test_one_tight_group_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 40)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=DIM)
    rows = [(i, np.float16(centre + 0.2 * rng.normal(size=DIM))) for i in range(150)] + [(1000 + i, np.float16(rng.normal(size=DIM))) for i in range(150)]
    found = clusters.clusters(table(spark, rows).repartition(3), rows_per_cell=8, node_rows=40)
    assert {(r.cluster_id, r.vec_id) for r in found.collect()} == true_clusters(rows)


def test_a_chain_is_no_cluster(spark):
    rng = np.random.default_rng(2)
    a, b = np.linalg.qr(rng.normal(size=(DIM, 2)))[0].T
    rows = [(i, np.float16(np.cos(t) * a + np.sin(t) * b)) for i, t in enumerate(np.linspace(0, 2.0, 12))]
    assert clusters.clusters(table(spark, rows)).count() == 0 and not true_clusters(rows)


def with_strays(n=40, seed=12):
    """Loose groups of eight, most with a vector outside that reaches one member only."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        centre = rng.normal(size=DIM)
        centre /= np.linalg.norm(centre)
        side = np.linalg.qr(np.c_[centre, rng.normal(size=(DIM, 10))])[0].T[1:]
        t = np.arccos(0.872)
        group = [np.cos(t) * centre + np.sin(t) * s for s in side[:8]]
        out += group
        if rng.random() < 0.8:
            out.append(0.78 * group[0] + np.sqrt(1 - 0.78**2) * (np.sin(t) * -centre + np.cos(t) * side[0]) * 0.6 + np.sqrt(1 - 0.78**2) * 0.8 * side[9])
    return [(int(i), v) for i, v in zip(rng.permutation(len(out)), out)]


def test_a_vector_that_reaches_one_member(spark):
    rows = [(i, np.float16(v)) for i, v in with_strays()]
    ids, c = cosines(rows)
    assert len(true_clusters(rows)) < 0.5 * len(rows)
    x = V.unit(np.array([v for _, v in rows], np.float32))
    group, whole = clusters.rejoin(x, clusters.compact_leaves(x, 0.75), 0.75)
    i, j = np.nonzero(c >= 0.75)
    assert (group[i] == group[j]).all()


@pytest.mark.parametrize("node_rows", [12_000, 40])
def test_groups_with_strays(spark, node_rows):
    rows = [(i, np.float16(v)) for i, v in with_strays()]
    found = clusters.clusters(table(spark, rows).repartition(3), rows_per_cell=6, node_rows=node_rows, margin=0.01)
    assert {(r.cluster_id, r.vec_id) for r in found.collect()} == true_clusters(rows)


def test_clusters_of_nothing(spark):
    assert clusters.clusters(table(spark, [(1, None)])).count() == 0
    assert clusters.clusters(table(spark, [(1, None)]).limit(0)).count() == 0


def test_describe(spark):
    good, rows = made(3)
    df = table(spark, rows)
    found = clusters.clusters(df)
    told = {r.cluster_id: r for r in clusters.describe(found, df.drop("cluster_id"), typical=3).collect()}
    members = {}
    for c, v in true_clusters(good):
        members.setdefault(c, []).append(v)
    assert {c: r.size for c, r in told.items()} == {c: len(m) for c, m in members.items()}
    by = dict(good)
    for c, m in members.items():
        x = np.array([np.asarray(by[i], np.float64) for i in sorted(m)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centre = x.sum(axis=0)
        s = np.round(x @ centre / np.linalg.norm(centre), 6)
        assert told[c].typical == [sorted(m)[k] for k in sorted(range(len(m)), key=lambda k: (-s[k], sorted(m)[k]))[:3]]


def test_neighbours(spark):
    good, rows = made(1, n_groups=25)
    lists = ivfpq.neighbours(table(spark, rows).repartition(3), rows_per_cell=30)
    got = {(r.a, r.b) for r in ivfpq.pairs(lists).collect()}
    want = true_pairs(good)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    ranked = {}
    for r in lists.collect():
        ranked.setdefault(r.vec_id, []).append((-r.cosine, r.neighbour))
        assert r.vec_id != r.neighbour and r.vec_id < 100_000 and r.neighbour < 100_000
    assert max(map(len, ranked.values())) <= 5


def test_neighbours_among_copies(spark):
    rng = np.random.default_rng(8)
    same = np.float16(rng.normal(size=DIM))
    rows = [(i, same) for i in range(60)] + [(100 + i, np.float16(rng.normal(size=DIM))) for i in range(60)]
    got = {(r.a, r.b) for r in ivfpq.pairs(ivfpq.neighbours(table(spark, rows).repartition(4), rows_per_cell=20)).collect()}
    assert got == true_pairs(rows)


def test_large_cells_are_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=DIM)
    rows = [(i, np.float16(centre + 0.4 * rng.normal(size=DIM))) for i in range(200)]
    x = V.unit(np.array([v for _, v in rows], np.float32))
    index = ivfpq.fit(x, 200, rows_per_cell=100, cell_rows=20)
    assert index.grid.sum() >= 8
    monkeypatch.setattr(ivfpq, "fit", lambda x, total, **_: index)
    got = {(r.a, r.b) for r in ivfpq.pairs(ivfpq.neighbours(table(spark, rows).repartition(3))).collect()}
    want = true_pairs(rows)
    assert len(got & want) / len(want) >= 0.95


def test_neighbours_of_nothing(spark):
    assert ivfpq.neighbours(table(spark, [(1, None)]).limit(0)).count() == 0
    assert ivfpq.neighbours(table(spark, [(1, None), (2, [0.0] * DIM)])).count() == 0
    assert ivfpq.neighbours(table(spark, [(1, [1.0] * DIM)])).count() == 0


def test_bytes_keep_vectors():
    x = np.array([[1.0, 0.1] * 64, [1e30, 1.0] * 64, [0.5, 0.25] * 64], np.float32)
    assert (V.from_bytes(V.to_bytes(x)) == x).all() and [len(b) for b in V.to_bytes(x)] == [512, 512, 256]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*pairs, (None, 1), (7, None)], "a bigint, b bigint")
    assert {r.node: r.component for r in graph.components(df).collect()} == {x: find(x) for x in label}
    assert graph.components(df.limit(0)).count() == 0


def test_few_pairs_are_followed_by_one_task(spark, monkeypatch):
    """A long chain among few pairs takes two tables; rounds over the cluster give the same."""
    chain = [int(x) for x in np.random.default_rng(1).permutation(300)]
    df = spark.createDataFrame([*zip(chain, chain[1:]), (1000, 1001), (1001, 1001), (None, 5)], "a bigint, b bigint")
    want, written, write = {**{x: 0 for x in chain}, 1000: 1000, 1001: 1000}, [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert {r.node: r.component for r in graph.components(df).collect()} == want and len(written) == 2
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert {r.node: r.component for r in graph.components(df).collect()} == want and len(written) > 4


def test_two_levels_and_a_grid(spark):
    """A first level of few cells is divided, a crowded cell cut into a grid; both find what one level finds."""
    good, rows = made(7, n_groups=20, noise=250)
    df, want = table(spark, rows).repartition(3), true_pairs(good)
    for settings in ({"max_cells": 4, "rows_per_cell": 25, "cell_rows": 90}, {"max_cells": 3, "rows_per_cell": 300, "cell_rows": 60}):
        got = {(r.a, r.b) for r in ivfpq.pairs(ivfpq.neighbours(df, **settings)).collect()}
        assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (len(got), len(want), len(got & want))


def test_exact_neighbours_and_ties(spark):
    good, rows = made(8, n_groups=6, noise=60)
    base = np.random.default_rng(3).normal(size=DIM)
    scaled = [(50_000 + i, np.float32(base) * np.float32(1 + i / 7)) for i in range(30)]  # one direction, no equal vectors
    good, rows = good + scaled, rows + scaled
    df = table(spark, rows)
    lists = ivfpq.neighbours(df, rows_per_cell=20, exact=True).collect()
    assert {(min(r.vec_id, r.neighbour), max(r.vec_id, r.neighbour)) for r in lists} >= true_pairs([g for g in good if g[0] < 50_000])
    of = {}
    for r in lists:
        of.setdefault(r.vec_id, []).append((round(-r.cosine, 6), r.neighbour))
    assert all(len(of[50_000 + i]) == 5 for i in range(30))


def test_groups_that_meet_across_tasks(spark):
    """Links between groups of different tasks are found by the radius of the groups, however far their centres are."""
    good, rows = made(9, n_groups=10, noise=120)
    want = true_clusters(good)
    for node_rows in (40, 90):
        found = {(r.cluster_id, r.vec_id) for r in clusters.clusters(table(spark, rows).repartition(3), rows_per_cell=5, node_rows=node_rows, margin=0.0, most_probes=1).collect()}
        assert found == want


def test_groups_go_as_balls(monkeypatch):
    """Rows near groups of other tasks are those of brute force, with a small part of its products."""
    rng = np.random.default_rng(2)
    sizes = rng.choice([1, 2, 5, 40, 60], 150)
    part, node, n = np.repeat(np.arange(150) * 3, sizes), np.repeat(rng.integers(0, 5, 150), sizes), np.repeat(sizes, sizes)
    x = V.unit(np.repeat(rng.normal(size=(12, DIM))[rng.integers(0, 12, 150)] + 0.8 * rng.normal(size=(150, DIM)), sizes, axis=0) + 0.4 * rng.normal(size=(len(part), DIM)))
    whole = np.repeat(rng.random(150) < 0.9, sizes)
    hubs = np.unique(part[whole])
    centres = V.unit(np.stack([x[part == g].sum(axis=0) for g in hubs]))
    radius, at = np.array([np.arccos((x[part == g] @ c).min().clip(-1, 1)) for g, c in zip(hubs, centres)]), np.searchsorted(part, hubs)
    size, home = n[at], node[at]
    near = (x @ centres.T >= clusters.bound(radius, 0.75)) & (node[:, None] != home)
    smaller = (n[:, None] < size) | (n[:, None] == size) & (part[:, None] < hubs)
    want = set(zip(*np.nonzero(near & (smaller | ~(whole & (n > 1))[:, None]))))
    products = []

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **settings):
            out = getattr(ufunc, method)(*(np.asarray(i) for i in inputs), **settings)
            products.append(out.size if ufunc is np.matmul else 0)
            return out

    for tile in ((512, 2048), (7, 11)):
        monkeypatch.setattr(clusters, "TILE", tile)
        held = clusters.Hubs(hubs, home, size, centres, radius, 0.75)
        held.balls, held.centres = held.balls.view(Counted), held.centres.view(Counted)
        assert set(zip(*held.near(x, part, node, n, whole))) == want and len(want) > 50
        assert len(x) * len(hubs) > 4 * sum(products) > 0
        products.clear()


def test_groups_of_several_blocks(spark, monkeypatch):
    """Groups that go to all tasks in several blocks, the largest first, leave nothing out."""
    monkeypatch.setattr(clusters, "HUB_BLOCK", 4)
    good, rows = made(11, n_groups=16, noise=80)
    found = clusters.clusters(table(spark, rows).repartition(3), rows_per_cell=5, node_rows=40, margin=0.0, most_probes=1)
    assert {(r.cluster_id, r.vec_id) for r in found.collect()} == true_clusters(good)
