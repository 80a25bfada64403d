"""Nearest vectors and clusters against brute force."""

import numpy as np
import pytest

from kinfold.llm import clustering, vectors


def data(rng, groups, size, dims=24, noise=0.12):
    rows = []
    for _ in range(groups):
        c = rng.standard_normal(dims)
        for _ in range(rng.integers(1, size + 1)):
            rows.append((c + noise * rng.standard_normal(dims)) * rng.uniform(0.1, 9))
    return rows


def frame(spark, rows, ks):
    out = [(int(i), [None if x != x else float(x) for x in v] if v is not None else None, k, "a", i) for i, (v, k) in enumerate(zip(rows, ks, strict=True))]
    out += out[:3]
    return spark.createDataFrame(out, "id bigint, v array<double>, k int, rep string, s bigint")


def unit(rows):
    m = np.array([np.nan_to_num(np.asarray(r, float)) for r in rows])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def brute(rows, ks, floor, default=5):
    ids = [i for i, r in enumerate(rows) if r is not None and np.nan_to_num(np.asarray(r, float)).any()]
    u = unit([rows[i] for i in ids])
    s = np.round(u @ u.T, 9)
    want = set()
    for x, i in enumerate(ids):
        k = default if ks[i] is None else ks[i]
        near = sorted((-s[x, y], j) for y, j in enumerate(ids) if j != i and s[x, y] >= floor)
        want |= {(i, j) for _, j in near[: max(k, 0)]}
    return want


@pytest.mark.parametrize("block", [None, 16])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = data(rng, 25, 8)
    rows[4] = rows[5].copy()
    rows[6] = rows[5].copy()
    rows[7][3] = np.nan
    for _ in range(15):
        rows.append(rows[9].copy())
    rows += [None, np.zeros(24)]
    ks = [[None, 1, 3, 8, 0, 40][i % 6] for i in range(len(rows))]
    got = vectors.nearest(frame(spark, rows, ks), "id", "v", "k", 5, 0.65, block=block)
    found = [(r["entity"], r["neighbour"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, ks, 0.65)


def test_nearest_in_a_dense_region(spark):
    rng = np.random.default_rng(2)
    rows = list(np.ones(24) + 0.05 * rng.standard_normal((700, 24)))
    got = vectors.nearest(frame(spark, rows, [3] * 700), "id", "v", "k", 5, 0.65, block=400)
    assert {(r["entity"], r["neighbour"]) for r in got.collect()} == brute(rows, [3] * 700, 0.65)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id bigint, v array<double>, k int")
    assert vectors.nearest(none, "id", "v", "k").count() == 0
    members, summary = clustering.clusters(none, "id", "v")
    assert members.count() == summary.count() == 0
    nulls = spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1), (3, [None, None], None)], "id bigint, v array<double>, k int")
    assert vectors.nearest(nulls, "id", "v", "k").count() == 0
    assert clustering.clusters(nulls, "id", "v")[0].count() == 0


def test_clusters_find_all_groups_and_are_cliques(spark):
    rng = np.random.default_rng(3)
    rows = data(rng, 40, 9)
    for _ in range(5):
        rows.append(rows[2].copy())
    u = unit(rows)
    s = np.round(u @ u.T, 9)
    members, summary = clustering.clusters(frame(spark, rows, [None] * len(rows)), "id", "v", 0.85)
    got = {tuple(r) for r in clustering.same_cluster_pairs(members).collect()}
    assert all(s[a, b] >= 0.85 for a, b in got)
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if s[i, j] >= 0.85}
    assert len(got & want) >= 0.99 * len(want)
    assert members.count() == len(rows)
    sizes = {r["cluster"]: r for r in summary.collect()}
    for r in members.groupBy("cluster").count().collect():
        assert sizes[r["cluster"]]["size"] == r["count"] and len(sizes[r["cluster"]]["typical"]) == min(3, r["count"])


def test_chains_are_divided_into_cliques(spark):
    angle = np.linspace(0, 3, 25)
    rows = [np.array([np.cos(a), np.sin(a)]) for a in angle]
    members, _ = clustering.clusters(frame(spark, rows, [None] * 25), "id", "v", 0.85)
    s = unit(rows) @ unit(rows).T
    groups: dict[int, list[int]] = {}
    for r in members.collect():
        groups.setdefault(r["cluster"], []).append(r["entity"])
    assert sum(map(len, groups.values())) == 25
    assert all(s[a, b] >= 0.85 - 1e-9 for g in groups.values() for a in g for b in g)


def test_a_large_group_stays_one_cluster(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(24)
    rows = [centre + 0.2 * rng.standard_normal(24) for _ in range(400)]
    rows += [rng.standard_normal(24) for _ in range(100)]
    s = np.round(unit(rows) @ unit(rows).T, 9)
    assert s[:400, :400].min() >= 0.85 > s[:400, 400:].max()
    members, _ = clustering.clusters(frame(spark, rows, [None] * len(rows)), "id", "v", 0.85)
    assert len({r["cluster"] for r in members.collect() if r["entity"] < 400}) == 1
    assert clustering.same_cluster_pairs(members).where("entity_a < 400").count() == 400 * 399 // 2
