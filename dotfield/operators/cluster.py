"""Density clustering in two dimensions or three, cluster statistics and the agreement of labellings."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import hull_area, hull_corners
from .graph import components
from .numbering import numbered
from .quantiles import with_medians
from .spatial import distance_along
from .storage import shuffled, written


def labels_of(points: DataFrame, pairs: DataFrame, groups: list[str], min_samples) -> DataFrame:
    """groups, loc_id, is_core, cluster from the pairs (groups, i, j) within eps.

    A point with at least min_samples points around it, itself included, is core; cores that are pairs are one cluster;
    clusters are numbered from 0 by their smallest core; another point takes the lowest cluster of a core beside it, else -1.
    """
    g = list(groups)
    pairs = written(pairs.select(*g, "i", "j"), "eps-pairs")
    both = pairs.unionByName(pairs.select(*g, F.col("j").alias("i"), F.col("i").alias("j")))
    degree = both.groupBy(*g, "i").agg((F.count(F.lit(1)) + 1).alias("n")).withColumnRenamed("i", "loc_id")
    need = F.lit(min_samples) if isinstance(min_samples, int) else F.col(min_samples)
    core = points.select(*g, "loc_id").join(degree, [*g, "loc_id"], "left").filter(F.coalesce("n", F.lit(1)) >= need).select(*g, "loc_id")
    core = written(core, "cores")
    inner = pairs.join(core.withColumnRenamed("loc_id", "i"), [*g, "i"], "left_semi").join(core.withColumnRenamed("loc_id", "j"), [*g, "j"], "left_semi")
    roots = components(inner, g).withColumnRenamed("node", "loc_id")
    cored = core.join(roots, [*g, "loc_id"], "left").select(*g, "loc_id", F.coalesce("root", "loc_id").alias("root"))
    names = numbered(cored.select(*g, "root").distinct(), g, "root", "cluster").withColumn("cluster", (F.col("cluster") - 1).cast("int"))
    cored = written(cored.join(names, [*g, "root"]).select(*g, "loc_id", "cluster"), "core-labels")
    beside = both.join(cored.withColumnRenamed("loc_id", "j"), [*g, "j"]).groupBy(*g, "i").agg(F.min("cluster").alias("__beside")).withColumnRenamed("i", "loc_id")
    out = points.select(*g, "loc_id").join(cored, [*g, "loc_id"], "left").join(beside, [*g, "loc_id"], "left")
    return out.select(*g, "loc_id", F.col("cluster").isNotNull().alias("is_core"), F.coalesce("cluster", "__beside", F.lit(-1)).cast("int").alias("cluster"))


#: Share of a pixel by which a centre may be off a hull's border and still be in it.
TOUCH = 1e-9
#: Cells are a bit smaller than eps / sqrt(axes), so that rounding cannot part two points of one cell; parts of a cell's side by the number of axes.
SHRUNK, PARTS = 1 - 1e-9, {2: 8, 3: 4}
PLANE = ("x", "y")


def _steps(axes: tuple[str, ...], after: bool = False) -> list[tuple[int, ...]]:
    """Steps from a cell to those that may have points within eps of its own; after: one of each two opposite ones, without 0."""
    every = product(range(-2, 3), repeat=len(axes))
    return [s for s in every if not after or s > (0,) * len(axes)]


def _around(df: DataFrame, axes: tuple[str, ...], steps: list[tuple[int, ...]]) -> DataFrame:
    """Each row in the cells at these steps from its own."""
    moved = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(axes, s, strict=True)]) for s in steps]))
    return df.withColumn("__s", moved).withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"__s.{c}") for c in axes}).drop("__s")


def _named(columns: list[str], prefix: str) -> list[str]:
    return [f"{prefix}{c}" for c in columns]


def in_cells(points: DataFrame, eps, g: list[str], axes: tuple[str, ...] = PLANE) -> DataFrame:
    """groups, loc_id, axes, cells c<axis> whose points are all within eps of each other, and parts s<axis> of them; without points that have a null axis."""
    side = eps / math.sqrt(len(axes)) * SHRUNK
    at = lambda c, s: F.floor(F.col(c) / F.lit(s)).cast("long")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in axes])
    some = points.filter(known).select(*g, "loc_id", *[F.col(c).cast("double").alias(c) for c in axes])
    return some.withColumns({**{f"c{c}": at(c, side) for c in axes}, **{f"s{c}": at(c, side / PARTS[len(axes)]) for c in axes}})


def _within(left: DataFrame, right: DataFrame, eps, g: list[str], axes: tuple[str, ...], *columns: str) -> DataFrame:
    """left's rows (few in every cell) with columns of right's points within eps."""
    cells = _named(axes, "c")
    other = right.select(*g, *cells, *[F.col(c).alias(f"{c}__b") for c in axes], *columns)
    return shuffled(_around(left, axes, _steps(axes)), other, [*g, *cells]).filter(distance_along(axes, "", "__b") <= eps)


def cores(at: DataFrame, eps, min_samples, g: list[str], axes: tuple[str, ...] = PLANE) -> DataFrame:
    """Points in cells with core: whether min_samples points, itself included, are within eps.

    All points of a cell are within eps of each other, so a cell of min_samples points has cores alone, and only points of
    other cells, of which there are fewer in each, are compared with their neighbours.
    """
    cells = _named(axes, "c")
    full = at.groupBy(*g, *cells).agg((F.count(F.lit(1)) >= min_samples).alias("core"))
    at = written(at.join(full, [*g, *cells]), "cells")
    near = _within(at.filter("not core").select(*g, "loc_id", *axes, *cells), at, eps, g, axes).groupBy(*g, "loc_id").agg((F.count(F.lit(1)) >= min_samples).alias("many"))
    return written(at.join(near, [*g, "loc_id"], "left").withColumn("core", F.col("core") | F.coalesce("many", F.lit(False))).drop("many"), "cores")


def _gap(a: str, b: str, eps, axes: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether boxes <axis>0 to <axis>1 with these endings may have points within eps, and whether all of their points are."""
    low = lambda c: F.greatest(F.col(f"{c}0{a}") - F.col(f"{c}1{b}"), F.col(f"{c}0{b}") - F.col(f"{c}1{a}"), F.lit(0.0))
    high = lambda c: F.greatest(F.col(f"{c}1{a}") - F.col(f"{c}0{b}"), F.col(f"{c}1{b}") - F.col(f"{c}0{a}"))
    norm = lambda f: F.sqrt(reduce(lambda p, q: p + q, [f(c) * f(c) for c in axes]))
    return norm(low) <= eps * (1 + 1e-12), norm(high) <= eps * (1 - 1e-12)


#: Cells along a side of a block, by the number of axes. A block's cells and those near its earlier sides meet in one task.
BLOCK = {2: 32, 3: 12}


def _firsts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the first node of its component, by the edges from a to b."""
    first = np.arange(n)
    while True:
        fa, fb = first[a], first[b]
        if (fa == fb).all():
            return first
        low, new = np.minimum(fa, fb), first.copy()
        np.minimum.at(new, fa, low)
        np.minimum.at(new, fb, low)
        while (new[new] != new).any():
            new = new[new]
        first = new


def _block_edges(pdf: pd.DataFrame, keys: list[str], g: list[str], axes: tuple[str, ...]) -> pd.DataFrame:
    """Edges of the cells in whole blocks (rows in order of keys): a cell's first one in its block by sure pairs (open: false), and pairs that these leave open."""
    n, size = len(pdf), BLOCK[len(axes)]
    new = np.zeros(n, bool)
    for c in keys:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at, wide = np.cumsum(new), size + 8
    for c in axes:
        at = at * wide + (pdf[f"c{c}"].to_numpy() - pdf[f"b{c}"].to_numpy() * size + 4)
    order = np.argsort(at)
    at = at[order]
    left, right = [], []
    for step in _steps(axes, after=True):
        to = at + reduce(lambda x, v: x * wide + v, step, 0)
        k = np.searchsorted(at, to)
        hit = np.flatnonzero((k < n) & (at[np.minimum(k, n - 1)] == to))
        left.append(order[hit])
        right.append(order[k[hit]])
    a, b = np.concatenate(left), np.concatenate(right)
    own = pdf.own.to_numpy()
    some = own[a] | own[b]
    a, b = a[some], b[some]
    eps, near, far = pdf.eps.to_numpy()[a], 0.0, 0.0
    for c in axes:
        lo, hi = pdf[f"{c}0"].to_numpy(), pdf[f"{c}1"].to_numpy()
        near = near + np.maximum(np.maximum(lo[a] - hi[b], lo[b] - hi[a]), 0.0) ** 2
        far = far + np.maximum(hi[a] - lo[b], hi[b] - lo[a]) ** 2
    may, sure = np.sqrt(near) <= eps * (1 + 1e-12), np.sqrt(far) <= eps * (1 - 1e-12)
    by_name = np.argsort(pdf.name.to_numpy(), kind="stable")
    place = np.empty(n, np.int64)
    place[by_name] = np.arange(n)
    first = by_name[_firsts(n, place[a[sure]], place[b[sure]])[place]]
    moved = np.flatnonzero(first != np.arange(n))
    left = np.flatnonzero(may & ~sure & (first[a] != first[b]))
    i, j = np.concatenate([first[moved], a[left]]), np.concatenate([moved, b[left]])
    out = pdf[g].iloc[i].reset_index(drop=True)
    names = pdf.name.to_numpy()
    return out.assign(i=names[i], j=names[j], open=np.arange(len(i)) >= len(moved))


def _cell_edges(cells: DataFrame, eps, g: list[str], axes: tuple[str, ...]) -> DataFrame:
    """Pairs (i, j, open) of cells, by their names: those that boxes around their cores join (not open), and those that boxes leave open.

    Cells meet in blocks, of which only edges to a component's first cell are kept, and open pairs that no others join.
    """
    c, ends = _named(axes, "c"), [f"{k}{n}" for k in axes for n in (0, 1)]
    size, blocks = BLOCK[len(axes)], _named(axes, "b")
    block = lambda k: F.floor(k / F.lit(size)).cast("long")
    placed = cells.select(*g, "name", *c, *ends, F.lit(eps).alias("eps") if isinstance(eps, (int, float)) else eps.cast("double").alias("eps"))
    for k in axes:
        placed = placed.withColumn(f"b{k}", F.explode(F.sequence(block(F.col(f"c{k}") - 2), block(F.col(f"c{k}") + 2))))
    here, home = F.struct(*blocks), F.struct(*[block(F.col(f"c{k}")).alias(f"b{k}") for k in axes])
    keys = [*g, *blocks]
    placed = placed.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in g], here >= home)).withColumn("own", here == home)
    placed = placed.repartition(*keys).sortWithinPartitions(*keys)
    kinds = dict(placed.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in g], f"i {kinds['name']}", f"j {kinds['name']}", "open boolean"])

    def edges(frames):
        kept = None
        for pdf in frames:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            last = np.ones(len(pdf), bool)
            for k in keys:
                last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
            whole = len(pdf) if not last.any() else int(last.argmax())  # the last block may go on
            kept = pdf.iloc[whole:].reset_index(drop=True)
            if whole:
                yield _block_edges(pdf.iloc[:whole], keys, g, axes)
        if kept is not None and len(kept):
            yield _block_edges(kept, keys, g, axes)

    return written(placed.mapInPandas(edges, schema), "cell-pairs")


def _point_edges(pairs: DataFrame, core: DataFrame, eps, g: list[str], axes: tuple[str, ...]) -> DataFrame:
    """Of pairs (i, j) of cells those with cores (points in cells with name) within eps.

    Boxes around parts of cells decide most. Points meet only in parts whose boxes leave it open, of cells that no other parts have joined.
    """
    s, ends = _named(axes, "s"), [f"{k}{n}" for k in axes for n in (0, 1)]
    box = [f(k).alias(f"{k}{n}") for k in axes for n, f in ((0, F.min), (1, F.max))]
    named = lambda df, end, *cols: df.select(*g, *[F.col(k).alias(f"{k}{end}") for k in cols])
    ended = lambda end: [f"{k}{end}" for k in s]
    may, all_ = _gap("a", "b", eps, axes)
    parts = core.groupBy(*g, "name", *s).agg(*box)
    met = shuffled(pairs, named(parts, "a", "name", *s, *ends).withColumnRenamed("namea", "i"), [*g, "i"])
    met = shuffled(met, named(parts, "b", "name", *s, *ends).withColumnRenamed("nameb", "j"), [*g, "j"])
    met = written(met.filter(may).select(*g, "i", "j", *ended("a"), *ended("b"), all_.alias("sure")), "part-pairs")
    joined = met.filter("sure").select(*g, "i", "j").distinct()
    left = shuffled(met, joined, [*g, "i", "j"], "left_anti").select(*g, "i", "j", *ended("a"), *ended("b"))
    side = lambda n, end: named(core, end, "name", *s, *axes).withColumnRenamed(f"name{end}", n)
    points = shuffled(shuffled(left, side("i", "a"), [*g, "i", *ended("a")]), side("j", "b"), [*g, "j", *ended("b")]).filter(distance_along(axes, "a", "b") <= eps)
    return joined.unionByName(points.select(*g, "i", "j").distinct())


def core_labels(core: DataFrame, eps, g: list[str], axes: tuple[str, ...] = PLANE) -> DataFrame:
    """Cores in cells with cluster: components of cells, numbered from 0 by their smallest core.

    Pairs that boxes around cells leave open are looked at only between components of the others.
    """
    at, s = _named(axes, "c"), _named(axes, "s")
    box = [f(k).alias(f"{k}{n}") for k in axes for n, f in ((0, F.min), (1, F.max))]
    cells = written(core.groupBy(*g, *at).agg(F.min("loc_id").alias("name"), *box), "core-cells")
    pairs = _cell_edges(cells, eps, g, axes)
    roots = components(pairs.filter("not open").select(*g, "i", "j"), g).withColumnRenamed("node", "name")
    cells = shuffled(cells.select(*g, *at, "name"), roots, [*g, "name"], "left").withColumn("root", F.coalesce("root", "name"))
    cells = written(cells, "cell-roots")
    root = lambda n: cells.select(*g, F.col("name").alias(n), F.col("root").alias(f"root_{n}"))
    left = pairs.filter("open").select(*g, "i", "j").distinct()
    left = written(shuffled(shuffled(left, root("i"), [*g, "i"]), root("j"), [*g, "j"]).filter("root_i <> root_j"), "open-pairs")
    if not left.isEmpty():
        asked = left.select(*g, F.explode(F.array("i", "j")).alias("name")).distinct()
        asked = shuffled(cells.select(*g, *at, "name"), asked, [*g, "name"], "left_semi")
        some = written(shuffled(core, asked, [*g, *at]).select(*g, "name", *s, *axes), "open-points")
        more = shuffled(left, _point_edges(left.select(*g, "i", "j"), some, eps, g, axes), [*g, "i", "j"], "left_semi")
        more = components(more.select(*g, F.col("root_i").alias("i"), F.col("root_j").alias("j")), g)
        cells = shuffled(cells, more.select(*g, F.col("node").alias("root"), F.col("root").alias("last")), [*g, "root"], "left")
        cells = written(cells.withColumn("root", F.coalesce("last", "root")).drop("last"), "cell-roots")
    names = numbered(cells.select(*g, "root").distinct(), g, "root", "cluster").withColumn("cluster", (F.col("cluster") - 1).cast("int"))
    cells = shuffled(cells, names, [*g, "root"]).drop("root", "name")
    return shuffled(core.drop(*s), cells, [*g, *at])


def labels_in_cells(at: DataFrame, eps, g: list[str], axes: tuple[str, ...] = PLANE) -> DataFrame:
    """groups, loc_id, is_core, cluster of points in cells whose core is known; clusters are components of cells."""
    core = written(core_labels(at.filter("core"), eps, g, axes), "core-labels")
    beside = _within(at.filter("not core").select(*g, "loc_id", *axes, *_named(axes, "c")), core, eps, g, axes, "cluster").groupBy(*g, "loc_id").agg(F.min("cluster").alias("cluster"))
    return core.select(*g, "loc_id", F.lit(True).alias("is_core"), "cluster").unionByName(beside.select(*g, "loc_id", F.lit(False).alias("is_core"), "cluster"))


def all_labels(points: DataFrame, found: DataFrame, g: list[str]) -> DataFrame:
    """Every point with what was found of it, noise otherwise."""
    out = points.select(*g, "loc_id").join(found, [*g, "loc_id"], "left")
    return out.select(*g, "loc_id", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def dbscan(points: DataFrame, eps, min_samples, groups: list[str] = (), axes: tuple[str, ...] = PLANE) -> DataFrame:
    """groups, loc_id, is_core, cluster; distances of eps count. axes: two columns or three.

    A point with at least min_samples points around it, itself included, is core; cores within eps are one cluster; clusters are
    numbered from 0 by their smallest core; another point takes the lowest cluster of a core beside it, else -1. Work grows with the points, not with their
    pairs: a dense place is a few cells of cores. eps and min_samples are numbers, or group columns if each group has its own.
    """
    g = list(groups)
    return all_labels(points, labels_in_cells(cores(in_cells(points, eps, g, axes), eps, min_samples, g, axes), eps, g, axes), g)


def dbscan_loop(points: DataFrame, eps, min_samples, groups: list[str] = (), rounds: int = 1000, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """groups, loc_id, cluster: fit, keep only cores, and fit again until none goes; those that went are -1.

    More rounds than `rounds` are an error, never an unfinished result. Cores that are left are joined into clusters once, at the end.
    """
    g = list(groups)
    at, n = written(in_cells(points, eps, g, axes), "loop-points"), None
    for _ in range(rounds):
        known = cores(at, eps, min_samples, g, axes)
        kept = known.filter("core")
        m = kept.count()
        if m == n or not m:
            break
        at, n = kept.drop("core"), m
    else:
        raise RuntimeError("the loop did not settle")
    return all_labels(points, labels_in_cells(known, eps, g, axes), g).drop("is_core")


def offset_ids(labels: DataFrame, order: str) -> DataFrame:
    """labels with cluster numbers that go on from one value of `order` to the next; -1 stays."""
    most = labels.groupBy(order).agg((F.max("cluster") + 1).alias("__n"))
    before = most.select(order, (F.sum("__n").over(W.orderBy(order)) - F.col("__n")).cast("int").alias("__before"))
    out = labels.join(before, order)
    return out.withColumn("cluster", F.when(F.col("cluster") < 0, F.col("cluster")).otherwise(F.col("cluster") + F.col("__before"))).drop("__before")


def named_clusters(labels: DataFrame, channel: str) -> DataFrame:
    """Without noise; cluster becomes text, with its channel."""
    return labels.filter("cluster <> -1").withColumn("cluster", F.concat(F.lit("ch"), F.col(channel).cast("string"), F.lit("_"), F.col("cluster").cast("string")))


def cluster_stats(labelled: DataFrame, groups: list[str] = (), hull: bool = True) -> DataFrame:
    """groups, cluster, n_points, centre, sample std, and hull area and density (null for noise or no area).

    Every group has a row for noise (-1).
    """
    g = list(groups)
    out = labelled.groupBy(*g, "cluster").agg(F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("x_center"), F.avg("y").alias("y_center"), F.stddev_samp("x").alias("x_std"), F.stddev_samp("y").alias("y_std"))
    noise = labelled.select(*g).distinct() if g else labelled.sparkSession.range(1).select()
    noise = noise.withColumn("cluster", F.lit(-1))
    out = out.join(noise, [*g, "cluster"], "full").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    if hull:
        areas = hull_area(labelled.filter("cluster <> -1"), [*g, "cluster"])
        out = out.join(areas, [*g, "cluster"], "left").withColumn("density", F.when(F.col("area") > 0, F.col("n_points") / F.col("area")))
    return out


def with_clusters(points: DataFrame, labels: DataFrame, groups: list[str] = ()) -> DataFrame:
    """All columns of points and the cluster of each; a cluster column that they had is replaced, a point without a label is noise."""
    key = [*groups, "loc_id"]
    return points.drop("cluster").join(labels.select(*key, "cluster"), key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def sizes(labelled: DataFrame, groups: list[str] = (), include_noise: bool = True) -> DataFrame:
    return (labelled if include_noise else labelled.filter("cluster <> -1")).groupBy(*groups, "cluster").agg(F.count(F.lit(1)).alias("n_points"))


def centres(labelled: DataFrame, groups: list[str] = ()) -> DataFrame:
    """groups, cluster, median x and y, and the largest distance of a member to them."""
    key = [*groups, "cluster"]
    some = labelled.filter("cluster <> -1")
    mid = with_medians(some.withColumns({"cx": F.col("x"), "cy": F.col("y")}), ["cx", "cy"], key)
    far = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    return some.join(mid, key).groupBy(*key, "cx", "cy").agg(F.max(far).alias("radius"))


def log_factorial(n) -> Column:
    """ln n! for n >= 0 by Stirling's series, taken seven places up; good to about 1e-12."""
    x = n + F.lit(8.0)
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    below = reduce(lambda p, k: p * (n + F.lit(float(k))), range(2, 8), n + F.lit(1.0))
    return (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(below)


def expected_information(sizes_u: DataFrame, sizes_v: DataFrame, n: Column) -> DataFrame:
    """One row, emi: the mutual information (in nats) to be expected of two labellings whose clusters have these sizes (m) out of n points.

    The sum runs over distinct sizes with their multiplicities, of which there are at most about sqrt(2 n), not over pairs of clusters.
    """
    per = lambda df, s, k: df.groupBy(F.col("m").cast("double").alias(s)).agg(F.count(F.lit(1)).alias(k))
    pairs = per(sizes_u, "a", "ka").crossJoin(F.broadcast(per(sizes_v, "b", "kb"))).withColumn("n", n.cast("double"))  # distinct sizes alone
    low, high = F.greatest(F.lit(1.0), F.col("a") + F.col("b") - F.col("n")).cast("long"), F.least("a", "b").cast("long")
    each = pairs.withColumn("k", F.explode(F.sequence(low, high))).withColumn("k", F.col("k").cast("double"))
    f = lambda c: log_factorial(c)
    a, b, k, n = (F.col(c) for c in "abkn")
    chance = F.exp(f(a) + f(b) + f(n - a) + f(n - b) - f(n) - f(k) - f(a - k) - f(b - k) - f(n - a - b + k))
    return each.agg(F.coalesce(F.sum(F.col("ka") * F.col("kb") * k / n * F.log(n * k / (a * b)) * chance), F.lit(0.0)).alias("emi"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: adjusted Rand index, Fowlkes-Mallows index, normalised and adjusted mutual information of two labellings of the same
    loc_ids, and their numbers of clusters and of noise points. Noise is a label like others; means of entropies are arithmetic."""
    both = a.select("loc_id", F.col("cluster").alias("u")).join(b.select("loc_id", F.col("cluster").alias("v")), "loc_id")
    cells = written(both.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("n")), "contingency")
    c2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda c: F.sum(-F.col(c) * F.log(c))
    inner = cells.agg(c2("n").alias("t"), F.sum("n").alias("n"), entropy("n").alias("huv"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(c2("m").alias(f"s{c}"), entropy("m").alias(f"h{c}"), F.count_if(F.col(c) != -1).alias(f"clusters_{c}"), F.count(F.lit(1)).alias(f"labels_{c}"), F.coalesce(F.sum(F.when(F.col(c) == -1, F.col("m"))), F.lit(0.0)).cast("long").alias(f"noise_{c}"))
    one = inner.crossJoin(side("u")).crossJoin(side("v"))  # single rows
    pairs = F.col("n") * (F.col("n") - 1) / 2
    expected = F.try_divide(F.col("su") * F.col("sv"), pairs)
    ari = F.try_divide(F.col("t") - expected, (F.col("su") + F.col("sv")) / 2 - expected)
    hu, hv, huv = [F.col(c) / F.col("n") + F.log("n") for c in ("hu", "hv", "huv")]
    total = inner.first()["n"]
    if total:
        by = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m"))
        one = one.crossJoin(expected_information(by("u"), by("v"), F.lit(total)))
    else:
        one = one.withColumn("emi", F.lit(0.0))
    least = F.lit(2.220446049250313e-16)  # fixed: as small as a difference of entropies is let become
    room = (hu + hv) / 2 - F.col("emi")
    room = F.when(room < 0, F.least(room, -least)).otherwise(F.greatest(room, least))
    alone = (F.col("labels_u") == F.col("labels_v")) & (F.col("labels_u") <= 1)
    ami = F.when(F.col("n").isNull() | alone, 1.0).otherwise((hu + hv - huv - F.col("emi")) / room)
    return one.select(F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(F.try_divide(F.col("t"), F.sqrt(F.col("su") * F.col("sv"))), F.lit(0.0)).alias("fm"), F.coalesce(F.try_divide(2 * (hu + hv - huv), hu + hv), F.lit(1.0)).alias("nmi"), ami.alias("ami"), "clusters_u", "clusters_v", "noise_u", "noise_v")


def hull_lines(labelled: DataFrame, box: tuple[float, float, float, float], pixels: int) -> DataFrame:
    """py, low, high: of every cluster's hull and every line of a pixels * pixels raster over box (x0, x1, y0, y1) the first and last pixel whose centre is in it."""
    x0, x1, y0, y1 = box
    dx, dy = (x1 - x0) / pixels, (y1 - y0) / pixels
    hulls = hull_corners(labelled.filter("cluster <> -1"), ["cluster"]).filter(F.size("hull") > 2)
    ys = F.transform("hull", lambda p: p["y"])
    row = lambda v, up: ((F.ceil if up else F.floor)((v - F.lit(y0)) / F.lit(dy) - 0.5 + F.lit(-TOUCH if up else TOUCH))).cast("int")
    first, last = F.greatest(row(F.array_min(ys), True), F.lit(0)), F.least(row(F.array_max(ys), False), F.lit(pixels - 1))
    lines = hulls.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("py", F.explode(F.sequence("first", "last")))
    y = F.least(F.greatest(F.lit(y0) + (F.col("py") + 0.5) * F.lit(dy), F.array_min(ys)), F.array_max(ys))
    after = F.concat(F.slice("hull", 2, F.size("hull") - 1), F.slice("hull", 1, 1))

    def meets(p, q):
        """Where an edge meets the line; a level edge is met by its neighbours."""
        across = (F.least(p["y"], q["y"]) <= y) & (F.greatest(p["y"], q["y"]) >= y) & (p["y"] != q["y"])
        return F.when(across, p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]))

    lines = lines.withColumn("xs", F.filter(F.zip_with("hull", after, meets), lambda v: v.isNotNull())).filter(F.size("xs") > 0)
    at = lambda v: (v - F.lit(x0)) / F.lit(dx) - 0.5
    low, high = F.ceil(at(F.array_min("xs")) - TOUCH), F.floor(at(F.array_max("xs")) + TOUCH)
    return lines.select("py", F.greatest(low, F.lit(0)).alias("low"), F.least(high, F.lit(pixels - 1)).alias("high")).filter("low <= high")


def pixels_of(lines: DataFrame) -> DataFrame:
    """One row, n: pixels in the union of intervals (py, low, high)."""
    before = F.max("high").over(W.partitionBy("py").orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1))
    new = lines.withColumn("new", F.greatest(F.col("high") - F.greatest(F.col("low") - 1, F.coalesce(before, F.col("low") - 1)), F.lit(0)))
    return new.agg(F.coalesce(F.sum("new"), F.lit(0)).alias("n"))


def hull_iou(a: DataFrame, b: DataFrame, pixels: int = 2400) -> DataFrame:
    """One row: pixels in the hulls of both labellings (x, y, cluster), in those of either, and their ratio.

    A hull is a few intervals, one for each line of pixels; what both have follows from the sizes of each side and of their union.
    """
    box = a.select("x", "y").unionByName(b.select("x", "y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None or box[1] <= box[0] or box[3] <= box[2]:
        return a.sparkSession.createDataFrame([(0, 0, None)], "both long, either long, iou double")
    la, lb = (written(hull_lines(x, tuple(box), pixels), "hull-lines") for x in (a, b))
    one = lambda df, name: pixels_of(df).withColumnRenamed("n", name)
    out = one(la, "a").crossJoin(one(lb, "b")).crossJoin(one(la.unionByName(lb), "either"))  # single rows
    out = out.select((F.col("a") + F.col("b") - F.col("either")).alias("both"), "either")
    return out.withColumn("iou", F.try_divide(F.col("both"), F.col("either")))
