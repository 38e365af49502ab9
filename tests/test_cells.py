"""Voronoi cells in two dimensions and three, and nearest sites, against brute force."""

import itertools

import numpy as np
import pytest

from dotfield.operators import cells, coloc, spatial

AXES = {2: ("x", "y"), 3: ("x", "y", "z")}


def table(spark, xyz):
    dims = xyz.shape[1]
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "loc_id long, " + ", ".join(f"{c} double" for c in AXES[dims]))


def sets(dims):
    rng = np.random.default_rng(dims)
    yield rng.uniform(0, 1, (60 if dims == 2 else 26, dims))
    yield np.concatenate([rng.normal(0, 1, (40 if dims == 2 else 14, dims)), rng.normal(50, 0.01, (40 if dims == 2 else 12, dims))])
    if dims == 2:
        t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
        yield np.concatenate([np.stack([np.cos(t), np.sin(t)], 1) * 10, rng.uniform(-1, 1, (30, 2))])


def brute(xyz, k):
    """Size of the cell of site k and the sites that bound it, from all meets of bisecting planes; None for an open cell."""
    dims = xyz.shape[1]
    o = np.delete(xyz, k, axis=0) - xyz[k]
    who, h = np.delete(np.arange(len(xyz)), k), (o * o).sum(1) / 2
    big = 1e5 * (xyz.max(0) - xyz.min(0)).max()
    o = np.concatenate([o, np.eye(dims), -np.eye(dims)])
    h, who = np.concatenate([h, np.full(2 * dims, big)]), np.concatenate([who, np.full(2 * dims, -1)])
    pairs = np.array(list(itertools.combinations(range(len(o)), dims)))
    ok = np.abs(np.linalg.det(o[pairs])) > 1e-12
    pairs = pairs[ok]
    v = np.linalg.solve(o[pairs], h[pairs][..., None])[..., 0]
    inside = (v @ o.T <= h + 1e-9 * np.maximum(1, np.abs(h))).all(1)
    v, pairs = v[inside], pairs[inside]
    total, beside = 0.0, set()
    for f in set(pairs.ravel().tolist()):
        on = v[(pairs == f).any(1)]
        if dims == 2:
            if len(on) < 2:
                continue
            length = np.sqrt(((on.max(0) - on.min(0)) ** 2).sum())
            part = length * h[f] / np.sqrt(o[f] @ o[f]) / 2
        else:
            if len(on) < 3:
                continue
            u = np.linalg.svd(o[f][None])[2][1:]
            q = (on - on.mean(0)) @ u.T
            q = q[np.argsort(np.arctan2(q[:, 1], q[:, 0]))]
            r = np.roll(q, -1, axis=0)
            part = abs((q[:, 0] * r[:, 1] - r[:, 0] * q[:, 1]).sum()) / 2 * h[f] / np.sqrt(o[f] @ o[f]) / 3
        if part > 1e-12:
            total += part
            beside.add(int(who[f]))
    return (None if -1 in beside else total), beside - {-1}


@pytest.mark.parametrize("dims", [2, 3])
def test_cells_against_brute_force(spark, dims):
    for xyz in sets(dims):
        got = {r.loc_id: r for r in cells.voronoi(table(spark, xyz), 3, AXES[dims]).collect()}
        assert len(got) == len(xyz)
        bounded = 0
        for k in range(len(xyz)):
            size, beside = brute(xyz, k)
            assert (got[k].area is None) == (size is None), k
            if size is not None:
                bounded += 1
                assert abs(got[k].area - size) <= 1e-6 * size, k
                assert set(got[k].neighbours) == beside
                assert abs(got[k].mean_neighbour_distance - np.mean([np.sqrt(((xyz[k] - xyz[j]) ** 2).sum()) for j in beside])) < 1e-9
        assert bounded > 2


def test_few_and_coincident_sites(spark):
    assert cells.voronoi(table(spark, np.zeros((0, 2)))).count() == 0
    for xyz in (np.zeros((3, 2)), np.array([[0, 0], [1, 1], [2, 2.0]])):
        rows = cells.voronoi(table(spark, xyz)).collect()
        assert all(r.area is None for r in rows) and len(rows) == len(np.unique(xyz, axis=0))


@pytest.mark.parametrize("dims", [2, 3])
def test_nearest_sites(spark, dims):
    """Within, on the border and far away; a dense clump among few others."""
    rng = np.random.default_rng(9)
    sites = np.concatenate([rng.uniform(0, 100, (200, dims)), rng.normal(30, 0.001, (300, dims))])
    asked = np.concatenate([rng.uniform(-20, 120, (60, dims)), rng.normal(30, 0.001, (20, dims)), rng.normal(0, 1e7, (20, dims)), sites[:3]])
    rows = table(spark, asked).withColumnRenamed("loc_id", "ask")
    for r in spatial.nearest_site(rows, table(spark, sites), AXES[dims]).collect():
        d = np.sqrt(((sites - asked[r.ask]) ** 2).sum(1))
        assert abs(r.d - d.min()) <= 1e-9 * max(1, d.min()) and d[r.site] <= d.min() * (1 + 1e-12) + 1e-12


def test_enrichment_of_solids(spark):
    rng = np.random.default_rng(4)
    sites, points = rng.uniform(0, 1, (40, 3)), rng.uniform(0, 1, (300, 3))
    got = coloc.relative_enrichment(table(spark, sites), table(spark, points), AXES[3]).collect()
    nearest = np.argmin(((points[:, None] - sites[None]) ** 2).sum(2), axis=1)
    width = sites[:, 0].max() - sites[:, 0].min()
    assert got
    for r in got:
        n, volume = int((nearest == r.loc_id).sum()), brute(sites, r.loc_id)[0]
        assert r.n_points == n and abs(r.enrichment - (n * width**3 / (300 * volume) if n else 0.1)) < 1e-6 * max(1, r.enrichment)


def test_neighbours_in_three_dimensions(spark):
    xyz = np.random.default_rng(5).normal(0, 1, (150, 3))
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    got = {(r.i, r.rank): r.j for r in spatial.knn_join(table(spark, xyz), None, 4, (), AXES[3]).collect()}
    assert got == {(i, k): int(np.argsort(d[i])[k]) for i in range(150) for k in range(1, 5)}
