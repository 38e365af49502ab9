"""Distance joins on a grid of cells: fixed radius, k nearest, nearest site, in two dimensions or three.

All take tables with loc_id, x, y and optional group columns; only points of one group meet. Points with a null
coordinate take no part. A join is an equi-join on cells followed by the distance, never a nested loop.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import shuffled, written


def distance(ax, ay, bx, by) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def distance_along(axes, left: str, right: str) -> Column:
    """Distance of two points of any number of axes, whose columns end in left and right."""
    gaps = [F.col(f"{c}{left}") - F.col(f"{c}{right}") for c in axes]
    return F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps]))


def _cell(c: Column, side) -> Column:
    return F.floor(c / side).cast("long")


def _around(steps: int) -> Column:
    return F.explode(F.sequence(F.lit(-steps).cast("long"), F.lit(steps).cast("long")))


def _span(c: Column, reach: float, side: float) -> Column:
    """A row for each cell that may hold a value within reach of c; a bit wider than that, for rounding."""
    wide = F.lit(reach * (1 + 1e-9)) + F.least(F.abs(c) * 1e-14, F.lit(float(reach)))
    return F.explode(F.sequence(_cell(c - wide, side), _cell(c + wide, side)))


def radius_join(left: DataFrame, right: DataFrame, r: float, groups: list[str] = (), extra: list[str] = (), band: tuple[str, int] | None = None, once: bool = False) -> DataFrame:
    """Pairs (groups, i, j, d) of left and right loc_ids with distance d <= r (both ends included).

    extra: further columns of both sides, given as i_<name> and j_<name>. band: (column, most) also asks for
    |left - right| <= most, and cuts cells along it. once: left and right are one table, whose pairs i < j are given once.
    """
    groups, extra = list(groups), list(dict.fromkeys([*extra, *([band[0]] if band else [])]))
    # Pairs that are given once meet in the later of their cells alone; that leaves room for larger cells and fewer copies of a point.
    side_of = r * 2 if once else r
    wide = 2 * band[1] + 1 if band else 1
    cell = [_cell(F.col("x"), side_of).alias("__cx"), _cell(F.col("y"), side_of).alias("__cy"), (_cell(F.col(band[0]), wide) if band else F.lit(0).cast("long")).alias("__cz")]
    keys = ["__cx", "__cy", "__cz"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.filter("x is not null and y is not null").select(*groups, F.col("loc_id").alias(tag), F.col("x").alias(f"__x{tag}"), F.col("y").alias(f"__y{tag}"), *[F.col(c).alias(f"{tag}_{c}") for c in extra], *cell)

    a = side(left, "i")
    b = side(right, "j").withColumnsRenamed({k: f"__home{k}" for k in keys})
    for k, c, reach, size in [("__cx", "__xj", r, side_of), ("__cy", "__yj", r, side_of), *([("__cz", f"j_{band[0]}", band[1], wide)] if band else [])]:
        b = b.withColumn(k, _span(F.col(c), reach, size))
    b = b if band else b.withColumn("__cz", F.lit(0).cast("long"))
    place, home = F.struct(*keys), F.struct(*[F.col(f"__home{k}").alias(k) for k in keys])
    b = b.filter(place >= home).withColumn("__own", place == home) if once else b
    b = b.drop(*[f"__home{k}" for k in keys])
    pairs = shuffled(a, b, [*groups, *keys]).withColumn("d", distance("__xi", "__yi", "__xj", "__yj")).filter(F.col("d") <= r)
    if band:
        pairs = pairs.filter(F.abs(F.col(f"i_{band[0]}") - F.col(f"j_{band[0]}")) <= band[1])
    if once:
        pairs = pairs.filter("i < j or i > j and not __own")
        turned = lambda p, q: F.when(F.col("i") < F.col("j"), F.col(p)).otherwise(F.col(q))
        return pairs.select(*groups, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d", *[turned(f"i_{c}", f"j_{c}").alias(f"i_{c}") for c in extra], *[turned(f"j_{c}", f"i_{c}").alias(f"j_{c}") for c in extra])
    return pairs.select(*groups, "i", "j", "d", *[f"i_{c}" for c in extra], *[f"j_{c}" for c in extra])


def radius_pairs(points: DataFrame, r: float, groups: list[str] = (), **how) -> DataFrame:
    """Each pair i < j of one group once."""
    return radius_join(points, points, r, groups, once=True, **how)


def mean_in_radius(points: DataFrame, others: DataFrame | None, r: float, groups: list[str] = (), empty: float | None = None) -> DataFrame:
    """loc_id, mean distance to the neighbours within r (without the point itself if others is None); empty where none."""
    pairs = radius_join(points, points if others is None else others, r, groups)
    if others is None:
        pairs = pairs.filter("i <> j")
    mean = pairs.groupBy("i").agg(F.avg("d").alias("mean_distance"), F.count(F.lit(1)).alias("neighbours"))
    out = points.select("loc_id").join(mean, F.col("loc_id") == F.col("i"), "left")
    return out.select("loc_id", F.coalesce("mean_distance", F.lit(empty).cast("double")).alias("mean_distance"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def first_side(spans: list[float], k: int, n: int) -> float:
    """Side of the cells that knn_join() begins with: of about k of n points if they fill a box of these spans, or a line."""
    share, long = max(k, 1) / max(n, 1), max(*spans, 1e-9)
    return max((math.prod(spans) * share) ** (1 / len(spans)), long * share) / 2


def knn_join(left: DataFrame, right: DataFrame | None, k: int, groups: list[str] = (), axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The k nearest of right (or of left's other points) for each left point: groups, i, j, d, rank; ties by j.

    Of points at one place only the k + 1 of the lowest loc_ids are looked at, as more can be among nobody's nearest; these are chosen before the shuffle.
    Cells start small and double. A point is done when its k-th distance is within the border of the cells around its own, or when
    these hold all points; only points that are not done go on to the next size, so dense places stay cheap. axes: two columns or three.
    """
    groups, own, axes = list(groups), right is None, list(axes)
    known = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in axes])
    side_of = lambda df, s: df.filter(known).select(*groups, F.col("loc_id").alias(s), *[F.col(c).alias(f"__{c}{s}") for c in axes])
    place = F.row_number().over(W.partitionBy(*groups, *[f"__{c}j" for c in axes]).orderBy("j"))
    b = side_of(left if own else right, "j").withColumn("__n", place).filter(F.col("__n") <= k + 1).drop("__n")
    a, b = written(side_of(left, "i"), "knn-left"), written(b, "knn-right")
    box = lambda d, s: d.agg(*[f(f"__{c}{s}") for c in axes for f in (F.min, F.max)], F.count(F.lit(1)).alias("n")).first()
    p, q = box(a, "i"), box(b, "j")
    empty = a.join(b, groups or F.lit(True)).limit(0) if not p.n or not q.n else None
    if empty is not None:
        return empty.select(*groups, "i", "j", F.lit(0.0).alias("d"), F.lit(1).alias("rank"))
    spans = [max(p[2 * n + 1], q[2 * n + 1]) - min(p[2 * n], q[2 * n]) for n in range(len(axes))]
    span, side = max(*spans, 1e-9), first_side(spans, k, q.n)
    cells = [f"__c{c}" for c in axes]
    done, todo, left_over = None, a, p.n
    rank = F.row_number().over(W.partitionBy(*groups, "i").orderBy("d", "j"))
    while True:
        last = side > span
        # The side with fewer points goes to the cells around its own.
        few = left_over * 2 < q.n
        home = "__h" if few else "__c"
        near = b.withColumns({f"__c{c}": _cell(F.col(f"__{c}j"), side) for c in axes})
        mine = todo.withColumns({f"{h}{c}": _cell(F.col(f"__{c}i"), side) for h in {home, "__c"} for c in axes})
        for c in axes:
            moved = (mine if few else near).withColumn("__u", _around(1)).withColumn(f"__c{c}", F.col(f"__c{c}") + F.col("__u")).drop("__u")
            mine, near = (moved, near) if few else (mine, moved)
        found = shuffled(mine, near, [*groups, *cells])
        if own:
            found = found.filter("i <> j")
        found = found.withColumn("d", distance_along([f"__{c}" for c in axes], "i", "j")).withColumn("rank", rank).filter(F.col("rank") <= k)
        if last:
            got = found.select(*groups, "i", "j", "d", "rank")
            return got if done is None else done.unionByName(got)
        # What lies outside the cells around is at least this far away.
        edge = F.least(*[e for c in axes for e in (F.col(f"__{c}i") - (F.col(f"{home}{c}") - 1) * F.lit(side), (F.col(f"{home}{c}") + 2) * F.lit(side) - F.col(f"__{c}i"))])
        every = W.partitionBy(*groups, "i")
        found = found.withColumn("__ok", (F.max("rank").over(every) == k) & (F.max("d").over(every) < F.max(edge).over(every)))
        got = written(found.filter("__ok").select(*groups, "i", "j", "d", "rank"), "knn-done")
        done = got if done is None else done.unionByName(got)
        todo = written(todo.join(got.select(*groups, "i").distinct(), [*groups, "i"], "left_anti"), "knn-todo")
        left_over = todo.count()
        if not left_over:
            return done
        side *= 2


#: Bits that a level of nearest_site() has more than the one above it, on each axis.
LEVEL_BITS = 2


def nearest_site(asked: DataFrame, sites: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """asked with site and d, the nearest of sites (loc_id and axes) to each of its points, wherever they lie; ties by loc_id.

    Occupied cells of a pyramid of grids are taken apart from the top. Of a point's cells those stay whose nearest corner is no farther than the
    farthest of the best one; so a point far outside keeps few cells too. asked has a key `ask`.
    """
    axes = list(axes)
    ends = sites.agg(*[f(c) for c in axes for f in (F.min, F.max)], F.count(F.lit(1)).alias("n")).first()
    if not ends.n:
        return asked.select("*", F.lit(None).cast("long").alias("site"), F.lit(None).cast("double").alias("d")).limit(0)
    low = {c: float(ends[2 * k]) for k, c in enumerate(axes)}
    span = max(max(float(ends[2 * k + 1]) - low[c] for k, c in enumerate(axes)), 1e-300) * (1 + 1e-9)
    levels = max(1, min(10, math.ceil(math.log2(max(ends.n / 2, 1)) / len(axes) / LEVEL_BITS)))
    bits = levels * LEVEL_BITS
    at = lambda c: F.least(F.floor((F.col(c) - F.lit(low[c])) / F.lit(span) * F.lit(float(1 << bits))), F.lit((1 << bits) - 1)).cast("long")
    placed = sites.select(F.col("loc_id").alias("site"), *[F.col(c).alias(f"__s{c}") for c in axes], *[at(c).alias(f"__c{c}") for c in axes])
    keys = [f"__c{c}" for c in axes]
    fine = written(placed.select(*keys).distinct(), "pyramid")

    def bounds(df: DataFrame, level: int) -> DataFrame:
        side = span / (1 << (level * LEVEL_BITS))
        lo = [F.greatest(F.lit(low[c]) + F.col(f"__c{c}") * F.lit(side) - F.col(c), F.col(c) - (F.lit(low[c]) + (F.col(f"__c{c}") + 1) * F.lit(side)), F.lit(0.0)) for c in axes]
        hi = [F.greatest(F.abs(F.lit(low[c]) + F.col(f"__c{c}") * F.lit(side) - F.col(c)), F.abs(F.lit(low[c]) + (F.col(f"__c{c}") + 1) * F.lit(side) - F.col(c))) for c in axes]
        root = lambda parts: F.sqrt(reduce(lambda a, b: a + b, [x * x for x in parts]))
        df = df.withColumn("__hi", F.min(root(hi)).over(W.partitionBy("ask")))
        return df.filter(root(lo) * (1 - 1e-9) <= F.col("__hi") * (1 + 1e-9)).drop("__hi")

    now = asked.select("ask", *axes, *[F.lit(0).cast("long").alias(k) for k in keys])
    for level in range(1, levels + 1):
        shift = (levels - level) * LEVEL_BITS
        cells = fine.select(*[F.shiftright(k, shift).alias(k) for k in keys]).distinct()
        cells = cells.select(*keys, *[F.shiftright(k, LEVEL_BITS).alias(f"__p{k}") for k in keys])
        parents = now.withColumnsRenamed({k: f"__p{k}" for k in keys})
        now = bounds(parents.join(cells, [f"__p{k}" for k in keys]).drop(*[f"__p{k}" for k in keys]), level)
    met = now.join(placed, keys).withColumn("d", F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"__s{c}")) * (F.col(c) - F.col(f"__s{c}")) for c in axes])))
    best = met.groupBy("ask").agg(F.min(F.struct("d", "site")).alias("__b"))
    return asked.join(best, "ask").select(*[asked[c] for c in asked.columns], F.col("__b.site").alias("site"), F.col("__b.d").alias("d"))


def nearest_counts(sites: DataFrame, points: DataFrame, groups: list[str] = (), axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """loc_id of each site, and how many points have it as nearest: what its Voronoi cell holds."""
    near = knn_join(points, sites, 1, groups, axes).groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    return sites.select("loc_id").join(near, F.col("loc_id") == F.col("j"), "left").select("loc_id", F.coalesce("n", F.lit(0)).alias("n_points"))
