"""Contracts of the operators on small tables with known results."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotfield.functions import geometry, names, precision
from dotfield.operators import cells, cluster, coloc, drift, filters, graph, merge, quantiles, spatial, tracks
from dotfield.plans import experiment
from dotfield.plans.config import Config
from dotfield.sources import tables
from dotfield.streaming import counts

FOUR = [(100.0, 200.0, 1, 80.0, 85.0, 500.0, 10.0, 0.01), (105.0, 202.0, 2, 90.0, 95.0, 400.0, 15.0, 0.05), (500.0, 500.0, 10, 40.0, 45.0, 100.0, 25.0, 0.2), (1000.0, 1000.0, 20, 300.0, 310.0, 600.0, 5.0, 0.02)]
NAMES = "x double, y double, frame int, sx double, sy double, photons double, lp double, pvalue double"


def points(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "loc_id long, x double, y double")


def test_cascade(spark):
    df = spark.createDataFrame(FOUR, NAMES)
    assert [r.x for r in filters.cascade(df, filters.Limits()).orderBy("x").collect()] == [100.0, 105.0]
    some = filters.Limits(sigma=None, pvalue=None)
    assert filters.cascade(df, some).count() == 3
    report = {r.step: (r.status, r.rows_before, r.rows_after) for r in filters.cascade_report(df.select("x", "y", "frame"), some).collect()}
    assert report["sigma"] == ("disabled", 4, 4) and report["photons"] == ("missing_columns", 4, 4)


def test_missing_values_never_pass(spark):
    df = filters.canonical(spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (400.0,)], "photons double"))
    assert filters.cascade(df, filters.Limits()).count() == 2
    assert filters.sanity(df).filter("reason = 'not_finite'").count() == 3 if {"x", "y"} <= set(df.columns) else True


def test_tracks(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1, 1), (2, 5.0, 5.0, 2, 1), (3, 1000.0, 1000.0, 50, 1)], "loc_id long, x double, y double, frame int, channel int")
    got = tracks.tracks(df, 50, 2, ["channel"]).orderBy("track_id").collect()
    assert [(r.track_id, r.n_locs, r.duration) for r in got] == [(1, 2, 2), (2, 1, 1)]
    assert tracks.policy_of("background (photons/nm^2)") == "sum" and tracks.policy_of("sx") == "rms" and tracks.policy_of("bg") == "mean"


def test_knn(spark):
    got = {r.i: r.d for r in spatial.knn_join(points(spark, [(0, 0), (3, 4), (10, 10)]), None, 1).collect()}
    assert got[0] == got[1] == 5
    cross = {r.i: r.d for r in spatial.knn_join(points(spark, [(0, 0), (10, 0)]), points(spark, [(3, 4)]), 1).collect()}
    assert cross[0] == 5 and math.isclose(cross[1], math.hypot(7, 4))
    assert spatial.knn_join(points(spark, []), None, 1).count() == 0
    assert spatial.knn_join(points(spark, [(0, 0)]), points(spark, [(1, 1), (2, 2)]), 5).count() == 2


def test_joins_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 1, (60, 2)), rng.uniform(-50, 50, (60, 2)), [[0, 0], [3, 0], [3, 0], [-3, 0]]]).round(3)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    df = points(spark, p)
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if d[i, j] <= 3}
    assert {(r.i, r.j) for r in spatial.radius_pairs(df, 3).collect()} == want
    got = {}
    for r in spatial.knn_join(df, None, 4).collect():
        got.setdefault(r.i, []).append((r.rank, r.j))
    for i in range(len(p)):
        order = sorted((round(d[i, j], 9), j) for j in range(len(p)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in order]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 102)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "i long, j long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == 100 and got[202] == 200
    assert graph.components(spark.createDataFrame([], "i long, j long")).count() == 0


def brute_dbscan(p, eps, least):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= least
    label, n = np.full(len(p), -1), 0
    for s in range(len(p)):
        if core[s] and label[s] < 0:
            todo = [s]
            while todo:
                a = todo.pop()
                for b in np.flatnonzero(d[a]):
                    if label[b] < 0:
                        label[b] = n
                        if core[b]:
                            todo.append(b)
            n += 1
    return label


def test_dbscan(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(6, 1, (30, 2)), [[3, 3], [40, 40]]])
    got = {r.loc_id: r.cluster for r in cluster.dbscan(points(spark, p), 1.2, 4).collect()}
    assert [got[k] for k in range(len(p))] == brute_dbscan(p, 1.2, 4).tolist()
    loop = {r.loc_id: r.cluster for r in cluster.dbscan_loop(points(spark, p), 1.2, 4).collect()}
    left = np.arange(len(p))
    while True:
        d = np.sqrt(((p[left][:, None] - p[left][None]) ** 2).sum(-1)) <= 1.2
        keep = d.sum(1) >= 4
        if keep.all():
            break
        left = left[keep]
    assert {k for k, v in loop.items() if v >= 0} == set(left.tolist())


def test_agreement(spark):
    a = spark.createDataFrame([(k, k // 5) for k in range(20)], "loc_id long, cluster int")
    r = cluster.agreement(a, a.withColumn("cluster", 9 - F.col("cluster"))).first()
    assert math.isclose(r.ari, 1) and math.isclose(r.fm, 1) and math.isclose(r.nmi, 1) and r.clusters_u == 4


def test_hull(spark):
    df = points(spark, [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (1, 3)]).withColumn("k", F.lit("a")).unionByName(points(spark, [(0, 0), (1, 1), (2, 2)]).withColumn("k", F.lit("line"))).unionByName(points(spark, [(0, 0), (1, 1)]).withColumn("k", F.lit("two")))
    assert {r.k: r.area for r in geometry.hull_area(df, ["k"]).collect()} == {"a": 16.0, "line": 0.0, "two": None}
    box = geometry.hull_corners(df.filter("k = 'a'"), ["k"])
    inside = box.select(geometry.inside_convex(F.lit(1.0), F.lit(1.0), F.col("hull")).alias("a"), geometry.inside_convex(F.lit(5.0), F.lit(1.0), F.col("hull")).alias("b")).first()
    assert inside.a and not inside.b


def test_hull_overlap(spark):
    square = lambda x0: points(spark, [(x0, 0), (x0 + 4, 0), (x0 + 4, 4), (x0, 4)]).withColumn("cluster", F.lit(0))
    r = cluster.hull_iou(square(0), square(2), 60).first()
    assert math.isclose(r.iou, 1 / 3, abs_tol=0.02)
    assert cluster.hull_iou(square(0), square(0), 40).first().iou == 1


def test_voronoi_lattice(spark):
    got = {r.loc_id: r for r in cells.voronoi(points(spark, [(i * 2, j * 2) for i in range(7) for j in range(7)])).collect()}
    inner = [i * 7 + j for i in range(1, 6) for j in range(1, 6)]
    assert all(math.isclose(got[k].area, 4.0) and got[k].mean_neighbour_distance == 2.0 for k in inner)
    assert all(got[k].area is None for k in range(49) if k not in inner)


def test_voronoi_counts_are_nearest_sites(spark):
    rng = np.random.default_rng(3)
    s, p = rng.uniform(0, 10, (12, 2)), rng.uniform(0, 10, (80, 2))
    want = np.bincount(((p[:, None] - s[None]) ** 2).sum(-1).argmin(1), minlength=12)
    got = {r.loc_id: r.n_points for r in spatial.nearest_counts(points(spark, s), points(spark, p)).collect()}
    assert [got[k] for k in range(12)] == want.tolist()


def test_cbc_range(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(0, 10, (60, 2))
    a, near, far = points(spark, p), points(spark, p + 0.01), points(spark, rng.normal(25, 3, (60, 2)))
    mean = []
    for b in (near, far):
        got = [r.cbc for r in coloc.cbc(a, b, 30, 6).collect() if r.cbc is not None]
        assert got and all(-1 <= v <= 1 for v in got)
        mean.append(sum(got) / len(got))
    assert mean[0] > 0.3 > mean[1]
    assert all(r.cbc is None for r in coloc.cbc(a, points(spark, []), 30, 6).collect())


def test_drift_is_recovered(spark):
    rng = np.random.default_rng(6)
    base = rng.uniform(0, 2000, (60, 2))
    rows = [(k * 60 + n, float(x + k * 0.2), float(y - k * 0.1), k + 1, "a") for k in range(200) for n, (x, y) in enumerate(base)]
    df = spark.createDataFrame(rows, "loc_id long, x double, y double, frame int, channel string")
    d = drift.estimate(df, segmentation=20, intersect=20, roi=60).orderBy("frame").collect()
    assert len(d) == 200 and max(abs(r.dx - (r.frame - 1) * 0.2) for r in d) < 3 and max(abs(r.dy + (r.frame - 1) * 0.1) for r in d) < 3
    t = np.linspace(0, 5, 9)
    assert np.allclose(drift.spline(t, t**3 - t, np.array([0.3, 2.2, 4.9])), np.array([0.3, 2.2, 4.9]) ** 3 - np.array([0.3, 2.2, 4.9]))
    assert len(drift.curve(np.zeros((1, 2)), 10, 5)) == 5
    v, replaced = drift.checked(np.array([[50.0, 0], [10, 0], [90, 0], [4, 0]]), 35, 10)
    assert v[:, 0].tolist() == [0.0, 10.0, 5.0, 4.0] and replaced.tolist() == [True, False, True, False]


def plain_match(x, y, segment, segments, size, reach, scale, first_only, leave_own_out):
    """One round for one channel, cell by cell."""
    cell = lambda a, b: list(zip(np.rint(a / size).astype(int).tolist(), np.rint(b / size).astype(int).tolist(), strict=True))
    use = segment == 0 if first_only else np.ones(len(x), bool)
    base, shifts = collections.Counter(cell(x[use], y[use])), np.zeros((segments, 2))
    for s in range(1 if first_only else 0, segments):
        run, here = shifts[:s].sum(axis=0), segment == s
        target = collections.Counter(cell(x[here] + run[0], y[here] + run[1]))
        ref = base - collections.Counter(cell(x[here], y[here])) if leave_own_out else base
        score = np.array([[sum(min(n, ref[u + i, v + j]) for (u, v), n in target.items()) for j in range(-reach, reach + 1)] for i in range(-reach, reach + 1)], float)
        if score.any():
            shifts[s] = drift._peak(score, reach, scale)
    return shifts


@pytest.mark.parametrize("first_only, leave_own_out", [(True, False), (False, False), (False, True)])
def test_drift_rounds_against_brute_force(spark, first_only, leave_own_out):
    rng = np.random.default_rng(8)
    base = rng.uniform(0, 600, (40, 2))
    rows = []
    for c in ("a", "b"):
        for s in (0, 1, 2, 4, 5):  # segment 3 is empty
            keep = rng.random(40) < 0.8
            rows += [(c, s, float(p + s * 4), float(q - s * 3)) for p, q in base[keep]]
    table = drift.written(spark.createDataFrame(rows, "channel string, segment int, x double, y double"), "test", by="segment")
    got = drift.match(table, "channel", {"a": 6, "b": 6}, 20, 3, 120 / 7, first_only, leave_own_out)
    for c in ("a", "b"):
        some = [r for r in rows if r[0] == c]
        want = plain_match(*(np.array([r[k] for r in some]) for k in (2, 3, 1)), 6, 20, 3, 120 / 7, first_only, leave_own_out)
        assert np.allclose(got[c], want)


def test_drift_of_two_channels(spark):
    """A second channel is moved back by the first one's drift; far shifts are mended, and the run has both."""
    rng = np.random.default_rng(9)
    base = rng.uniform(100, 1500, (40, 2))
    rows = [(len(base) * (2 * k + c) + n, float(x + k * 0.3), float(y), k + 1, "ab"[c]) for c in (0, 1) for k in range(60) for n, (x, y) in enumerate(base)]
    df = spark.createDataFrame(rows, "loc_id long, x double, y double, frame int, channel string")
    out = experiment.run(df, Config.model_validate({"drift": {"segmentation": 10}, "linking": {"use": False}, "regions": {"use": False}, "neighbours": {"use": False}, "clustering": {"use": False}, "colocalization": {"use": False}}))
    assert out["segments"].count() == 12 and not out["segments"].filter("replaced").count()
    x = {r.channel: r.x for r in out["filtered"].groupBy("channel").agg(F.avg("x").alias("x")).collect()}
    assert abs(x["a"] - x["b"] - 59 * 0.3) < 3
    jump = df.withColumn("x", F.col("x") + F.when((F.col("frame") > 30) & (F.col("frame") <= 40), 45.0).otherwise(0.0))
    d, seg = drift.estimated(jump, segmentation=10, limit=20)
    assert seg.filter("replaced").count() >= 2 and d.count() == 120
    assert d.agg(F.max(F.abs("dx"))).first()[0] < 45


def test_numbers_are_gapless(spark):
    from dotfield.operators.numbering import numbered

    rng = np.random.default_rng(10)
    rows = [(None if k % 3 == 0 else "ab"[k % 2], int(rng.integers(-5, 5000)) * (10**12 if k % 7 == 0 else 1), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, k long")
    for groups in ([], ["g"]):
        got = numbered(df, groups, "v", "n", ["k"]).collect()
        for g in {r.g if groups else 0 for r in got}:
            some = sorted((r for r in got if not groups or r.g == g), key=lambda r: (r.v, r.k))
            assert [r.n for r in some] == list(range(1, len(some) + 1))


def test_dbscan_loop_against_brute_force(spark):
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.normal(c, 12, (40, 2)) for c in (0, 60, 200)] + [rng.uniform(-100, 300, (30, 2))])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "loc_id long, x double, y double")
    got = {r.loc_id: r.cluster for r in cluster.dbscan_loop(df, 9, 5).collect()}
    near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= 81
    left = np.ones(len(xy), bool)
    while True:
        core = left & ((near & left).sum(axis=1) >= 5)
        if (core == left).all():
            break
        left = core
    label = np.full(len(xy), -1)
    for k in np.flatnonzero(left):
        if label[k] < 0:
            todo, label[k] = [k], label.max() + 1
            while todo:
                a = todo.pop()
                for b in np.flatnonzero(near[a] & left & (label < 0)):
                    label[b] = label[k]
                    todo.append(b)
    assert label.max() > 0 and [got[k] for k in range(len(xy))] == label.tolist()


def test_precision(spark):
    df = spark.createDataFrame([(100.0, 1000.0, 0.0), (100.0, 1000.0, 5.0), (-1.0, 1000.0, 5.0)], "sigma double, photons double, bg double")
    got = [r[0] for r in df.select(precision.precision(F.col("sigma"), F.col("photons"), F.col("bg"), 117)).collect()]
    assert math.isclose(got[0], math.sqrt((100**2 + 117**2 / 12) / 1000)) and got[1] > got[0] and got[2] is None
    assert np.allclose(precision.dilog_minus(np.array([0.0, 1.0, 10.0])), [0, -(math.pi**2) / 12, -4.198277886858104])
    with pytest.raises(ValueError):
        precision.resolve_sigma(["x"])


def test_names(spark):
    df = spark.createDataFrame([("Test_PEX14_TOMM20",), ("AHA_24022_U2OS-WT_AST0126_AST0063-2_posXY1",), ("one",)], "s string")
    one, two = names.stem_labels(F.col("s"))
    assert [tuple(r) for r in df.select(one, two).collect()] == [("PEX14", "TOMM20"), ("AST0126", "AST0063-2"), ("one", "Ch2")]
    files = spark.createDataFrame([("x_ast0126_TO_RST7-2.csv",), ("y_rst0063_to_Pst9.csv",), ("inter_a_to_b.csv",), ("cluster_inter_c_to_d.csv",), ("mean_distance_radius_50.0_e.csv",), ("mean_distance_radius_5.5_e_to_f.csv",), ("intra_g.csv",)], "s string")
    told = files.select(names.probe(F.col("s")), *names.probe_pair(F.col("s")), *names.inter_channels(F.col("s")), *names.distance_channels(F.col("s")), names.prefixed_channel(F.col("s"), "intra_")).collect()
    n = None
    assert [tuple(r) for r in told] == [("AST0126", n, n, n, n, n, n, n), ("RST0063", "RST0063", "PST9", n, n, n, n, n), (n, n, n, "a", "b", n, n, n), (n, n, n, "c", "d", n, n, n), (n, n, n, n, n, "e", n, n), (n, n, n, n, n, "e", "f", n), (n, n, n, n, n, n, n, "g")]
    lasts = spark.createDataFrame([("1", "10"), ("1", "10.0"), ("1", "10.5"), ("none", "10"), ("1", None), ("1", "x")], "i string, l string")
    assert [r[0] for r in lasts.select(names.is_dual(F.col("i"), F.col("l"))).collect()] == [True, True, False, False, False, False]
    assert names.header_text("  File   Name ") == "file name"
    assert df.select(names.header(F.lit("  File   Name "))).first()[0] == "file name"
    assert names.columns_alike(["distance_a-1", "distance_a", "n"]) == {"distance_a": ["distance_a-1", "distance_a"], "n": ["n"]}


def test_loading(spark, tmp_path):
    def made(name, text):
        (tmp_path / name).write_text(text)
        return tables.load(spark, str(tmp_path / name))

    assert "non-zero" in made("a.csv", "x (nm),y (nm),z (nm),channelIndex,frameIndex\n1,2,10,1,1\n1,2,20,1,2\n").reason
    blank = made("b.csv", "x (nm),y (nm),z (nm),channelIndex,frameIndex,channelName\n1,2,,1,1,a\n1,2,0,1,2,a\n")
    assert "z (nm)" not in blank.table.columns and "channelName" not in blank.table.columns and blank.warning and blank.table.count() == 2
    for k, header in enumerate(("z", "Z", "z(nm)", "Z (nm)", "z [nm]", "z[nm]", "position_z", "Position Z [nm]", " z ")):
        assert "non-zero" in made(f"z{k}.csv", f"x (nm),y (nm),{header},channelIndex,frameIndex\n1,2,3,1,1\n").reason
    assert made("c.csv", "y (nm),channelIndex,frameIndex\n1,1,1\n").reason.startswith("Missing required columns")
    assert tables.load(spark, str(tmp_path / "none.csv")).table is None
    assert set(tables.internal(blank.table).columns) == {"x", "y", "channel", "frame"}


def test_merge(spark):
    a, b = spark.createDataFrame([(1, 5.0)], "k int, v double"), spark.createDataFrame([(2, "x")], "k int, w string")
    assert merge.stacked({"a": a, "b": b}).columns == ["k", "v", "source", "w"]
    two = spark.createDataFrame([(1, None, 3.0)], "k int, `d_a-1` double, d_a double")
    assert merge.coalesced_alike(two).first().asDict() == {"k": 1, "d_a": 3.0}


def test_config():
    assert Config().linking.max_frame_gap == 2
    for bad in ({"unknown": 1}, {"filtering": {"sigma": {"min": 5, "max": 5}}}, {"linking": {"min_duration": 9, "max_duration": 3}}, {"drift": {"segmentation": 0}}):
        with pytest.raises(ValueError):
            Config.model_validate(bad)


def test_filters_of_a_stream(spark, tmp_path):
    """What a stream passes is what the batch passes; its running counts are observed."""
    rows = [(k, float(k % 300), 50.0 + k % 200, 200.0 + k, 5.0 + k % 30) for k in range(400)]
    df = spark.createDataFrame(rows, "loc_id long, x double, sx double, photons double, lp double").withColumn("sy", F.col("sx"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    limits = filters.Limits((60, 200), 300, 20, None)
    stream = counts.filtered_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limits)
    got = sorted(r.loc_id for r in counts.drained(stream, "filtered").collect())
    assert got == sorted(r.loc_id for r in filters.cascade(df, limits).collect()) and 0 < len(got) < 400


def test_precision_headers(spark):
    h = precision.Headers()
    assert h.inputs() == ["intensity (photons)", "background (photons/nm^2)", "sigmaX (nm)", "sigmaY (nm)"] and h.carried()[0] == "LP_calculated"
    df = spark.createDataFrame([(1, 1000.0, 0.001, 120.0, 110.0, 8.0), (2, 2000.0, 0.002, 130.0, 125.0, 7.0)], "id int, `intensity (photons)` double, `background (photons/nm^2)` double, `sigmaX (nm)` double, `sigmaY (nm)` double, `localization precision (nm)` double")
    moved = precision.carried_through(df, df.select("id"), ["id"], h)
    got = precision.with_precision(moved, h, 117, unit="per_nm2").orderBy("id").collect()
    assert all(0 < r.LP_calculated < 20 for r in got) and got[0].LP_calculated > got[1].LP_calculated
    with pytest.raises(ValueError):
        precision.with_precision(df.drop("intensity (photons)"), h, 117)
    with pytest.raises(ValueError):
        precision.with_precision(df.drop("sigmaX (nm)"), h, 117)


def test_clusters_keep_columns(spark):
    pts = points(spark, [(0, 0), (1, 0), (50, 50)]).withColumn("cluster", F.lit(7)).withColumn("note", F.lit("n"))
    labels = spark.createDataFrame([(0, 4), (1, 4)], "loc_id long, cluster int")
    got = sorted((r.loc_id, r.cluster, r.note) for r in cluster.with_clusters(pts, labels).collect())
    assert got == [(0, 4, "n"), (1, 4, "n"), (2, -1, "n")]
    assert cluster.sizes(cluster.with_clusters(pts, labels), include_noise=False).count() == 1


def test_expected_information(spark):
    """By the sum over all contingency counts, with logarithms of factorials from the library."""
    u, v = [1, 1, 3, 5, 30], [10, 10, 20]
    n, want = 40, 0.0
    f = math.lgamma
    for a in u:
        for b in v:
            for k in range(max(1, a + b - n), min(a, b) + 1):
                p = math.exp(f(a + 1) + f(b + 1) + f(n - a + 1) + f(n - b + 1) - f(n + 1) - f(k + 1) - f(a - k + 1) - f(b - k + 1) - f(n - a - b + k + 1))
                want += k / n * math.log(n * k / (a * b)) * p
    table = lambda s: spark.createDataFrame([(x,) for x in s], "m long")
    assert abs(cluster.expected_information(table(u), table(v), F.lit(n)).first().emi - want) < 1e-9
    got = spark.range(0, 200).select(cluster.log_factorial(F.col("id").cast("double"))).collect()
    assert all(abs(r[0] - f(k + 1)) < 1e-9 * max(1, f(k + 1)) for k, r in enumerate(got))
    same = spark.createDataFrame([(k, k % 3) for k in range(30)], "loc_id long, cluster int")
    assert abs(cluster.agreement(same, same).first().ami - 1) < 1e-9


def test_dbscan_in_dense_places(spark):
    """Clumps of many points in few cells, chains of cells, borders at exactly eps: as by all pairs. The rows made grow with the points."""
    rng = np.random.default_rng(31)
    xy = np.concatenate([rng.normal(0, 0.3, (400, 2)), rng.normal((6, 0), 0.3, (400, 2)), rng.uniform(-10, 20, (150, 2)), [(30 + k * 0.7, 5) for k in range(40)], [(50 + i, 50 + j) for i in range(6) for j in range(6)], np.full((30, 2), 80.0)])
    pts = points(spark, xy.tolist())
    for eps, least in ((1.0, 4), (0.5, 10), (2.0, 3)):
        got = {r.loc_id: (r.is_core, r.cluster) for r in cluster.dbscan(pts, eps, least).collect()}
        want = {r.loc_id: (r.is_core, r.cluster) for r in cluster.labels_of(pts, spatial.radius_pairs(pts, eps), [], least).collect()}
        assert got == want


def test_hull_lines_against_pixels(spark):
    """Overlapping hulls on a coarse raster, every pixel's centre tested against every hull."""
    rng = np.random.default_rng(8)
    labellings = [[(float(x), float(y), k) for k in range(4) for x, y in rng.normal((k * 3 + shift, k % 2), 1.2, (12, 2))] for shift in (0, 1)]
    a, b = (spark.createDataFrame(rows + [(20.0, 20.0, -1), (-5.0, -6.0, -1)], "x double, y double, cluster int") for rows in labellings)
    n, masks = 60, []
    for rows in labellings:
        inside = set()
        for k in range(4):
            h = geometry.hull(np.array([r[:2] for r in rows if r[2] == k]))
            e = np.roll(h, -1, axis=0) - h
            for px in range(n):
                for py in range(n):
                    c = np.array([-5 + (px + 0.5) * 25 / n, -6 + (py + 0.5) * 26 / n])
                    if (e[:, 0] * (c[1] - h[:, 1]) - e[:, 1] * (c[0] - h[:, 0]) >= 0).all():
                        inside.add((px, py))
        masks.append(inside)
    got = cluster.hull_iou(a, b, n).first()
    assert (got.both, got.either) == (len(masks[0] & masks[1]), len(masks[0] | masks[1])) and got.both > 20


@pytest.mark.parametrize("small, accuracy", [(100_000, 10_000), (50, 100)])
def test_quantiles(spark, monkeypatch, small, accuracy):
    """Of large groups only values between the bounds are counted one by one."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(41)
    values = {"a": rng.normal(0, 1, 3000), "b": rng.integers(0, 4, 2000).astype(float), "c": np.array([5.0]), "d": np.array([1.0, 2.0]), None: rng.exponential(1, 777)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    at = {"low": 0.1, "mid": 0.5, "high": 0.9, "last": 1.0}
    got = {r.k: r for r in quantiles.quantiles(df, "v", ["k"], at).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert np.allclose([got[k][n] for n in at], np.quantile(v, list(at.values())), rtol=1e-12, atol=1e-12)
    every = np.concatenate(list(values.values()))
    assert math.isclose(quantiles.quantiles(df, "v", [], {"m": 0.5}).first().m, np.median(every), rel_tol=1e-12)
