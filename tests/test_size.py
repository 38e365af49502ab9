"""That no table goes through the driver because its files are small, and results of what keeps it from that."""

import numpy as np
import pytest

from dotfield.operators import cluster, graph, spatial, storage, tracks
from dotfield.plans import catalogue


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def located(spark, n, seed, span=20.0):
    rng = np.random.default_rng(seed)
    xy = rng.integers(-int(span), int(span) + 1, (n, 2)) / 2  # many distances are r itself, many points on a border
    frame, channel = rng.integers(-6, 7, n), rng.integers(0, 2, n)
    rows = [(k, float(x), float(y), int(f), int(c)) for k, ((x, y), f, c) in enumerate(zip(xy, frame, channel, strict=True))]
    return rows, spark.createDataFrame([*rows, (n, None, 1.0, 1, 1), (n + 1, 1.0, 1.0, None, 1)], "loc_id long, x double, y double, frame int, channel int")


def test_linked_points_are_not_broadcast(spark, tmp_path):
    _, df = located(spark, 200, 1)
    df.write.parquet(str(tmp_path / "points"))
    df = spark.read.parquet(str(tmp_path / "points"))  # files of a few KB
    assert broadcasts(tracks.link_edges(df, 2, 2, ["channel"])) == 0


@pytest.mark.parametrize("r, gap", [(1.5, 2), (2.0, 0), (0.5, 5)])
def test_linked_pairs_equal_brute_force(spark, r, gap):
    rows, df = located(spark, 300, 2)
    near = lambda a, b: np.hypot(a[1] - b[1], a[2] - b[2]) <= r
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[4] == b[4] and abs(a[3] - b[3]) <= gap and near(a, b)}
    got = [(e.i, e.j) for e in tracks.link_edges(df, r, gap, ["channel"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = spatial.radius_pairs(df.filter(f"loc_id < {len(rows)}"), r, extra=["frame"]).collect()
    assert {(e.i, e.j): (e.i_frame, e.j_frame) for e in got} == {(a[0], b[0]): (a[3], b[3]) for a in rows for b in rows if a[0] < b[0] and near(a, b)}
    got = [(e.i, e.j) for e in spatial.radius_join(df.filter("channel = 0"), df.filter("channel = 1"), r, band=("frame", gap)).collect()]
    assert len(got) == len(set(got)) and {k for k in got if max(k) < len(rows)} == {(a[0], b[0]) for a in rows for b in rows if a[4] == 0 and b[4] == 1 and abs(a[3] - b[3]) <= gap and near(a, b)}


def test_components_of_many_edges_are_not_broadcast(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51)], "i long, j long")
    monkeypatch.setattr(graph, "BROADCAST", 10)
    seen = []
    monkeypatch.setattr(graph, "written", lambda df, name: seen.append(broadcasts(df)) or storage.written(df, name))
    got = {r.node: r.root for r in graph.components(chain).collect()}
    assert set(got) == {*range(31), 50, 51} and all(got[k] == (50 if k > 49 else 0) for k in got)
    assert len(seen) > 2 and not any(seen)


def test_tracks_meet_their_points_by_shuffle(spark, monkeypatch):
    _, df = located(spark, 200, 3)
    met = []
    monkeypatch.setattr(tracks, "shuffled", lambda a, b, *how: met.append(b.columns) or storage.shuffled(a, b, *how))
    got = tracks.tracks(df, 2, 2, ["channel"])
    assert met == [["channel", "loc_id", "root"]] and sum(r.n_locs for r in got.collect()) == 200


@pytest.mark.parametrize("name", ["link_tracks", "track_durations"])
def test_edges_of_a_query_are_not_broadcast(spark, monkeypatch, name):
    seen = {}
    monkeypatch.setattr(graph, "written", lambda df, what: seen.setdefault(what, broadcasts(df)) and None or storage.written(df, what))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert seen["edges"] == 0


def test_cells_and_neighbours_are_not_broadcast(spark, monkeypatch):
    _, df = located(spark, 300, 4)
    seen = {}
    for where in (cluster, spatial):
        monkeypatch.setattr(where, "written", lambda df, what: seen.setdefault(what, broadcasts(df)) and None or storage.written(df, what))
    assert cluster.dbscan(df, 1.5, 4, ["channel"]).count() == 302
    spatial.knn_join(df, None, 3, ["channel"])
    assert seen["part-pairs"] == seen["knn-done"] == 0


@pytest.mark.parametrize("axes, n, span", [(("x", "y"), 700, 90), (("x", "y", "z"), 700, 36)])
def test_cells_in_many_blocks_equal_brute_force(spark, monkeypatch, axes, n, span):
    p = np.random.default_rng(6).integers(-span, span, (n, len(axes))) / 2.0
    p[: n // 2] = p[: n // 2].round() / (4, 8)[len(axes) - 2]  # dense beside sparse
    eps, least = 2.0, 3
    names = ", ".join(f"{c} double" for c in axes)
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], f"loc_id long, {names}")
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    root = np.where(core, np.arange(n), n)
    while True:
        new = np.where(core, np.where(near & core[None], root[None], n).min(1), n)
        if (new == root).all():
            break
        root = new
    number = {r: k for k, r in enumerate(sorted({*root[core]}))}
    want = {k: number[root[k]] if core[k] else min((number[root[j]] for j in np.flatnonzero(near[k] & core)), default=-1) for k in range(n)}
    shuffles = []
    monkeypatch.setattr(cluster, "written", lambda df, what: storage.written(df, what) if what != "cell-pairs" else shuffles.append(storage.written(df, what)) or shuffles[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # blocks go on in the next batch
    try:
        assert {r.loc_id: r.cluster for r in cluster.dbscan(df, eps, least, axes=axes).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # A cell has an edge to the first one of its component in each block, not to each cell around.
    edges = shuffles[0].filter("not open")
    assert 0 < edges.count() <= 3 * edges.select("j").distinct().count() and len(number) > 4


def test_nearest_neighbours_on_a_strip_begin_with_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(7)
    p = np.column_stack([rng.uniform(0, 5, 600), rng.uniform(0, 60_000, 600)]).round(3)
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "loc_id long, x double, y double")
    sides = []
    monkeypatch.setattr(spatial, "_cell", lambda c, side, f=spatial._cell: sides.append(side) or f(c, side))
    got = {(r.i, r.rank): r.j for r in spatial.knn_join(df, None, 2).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) + np.diag(np.full(600, np.inf))
    assert got == {(i, r + 1): int(np.argsort(d[i], kind="stable")[r]) for i in range(600) for r in range(2)}
    assert min(sides) * 600 < 4 * 60_000 and len(set(sides)) < 15
    assert spatial.first_side([0.0, 100.0], 1, 50) == 1.0 and spatial.first_side([10.0, 10.0], 1, 25) == 1.0
