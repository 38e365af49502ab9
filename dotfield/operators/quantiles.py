"""Exact quantiles of groups of any size, by narrowing down.

A first pass takes sketches, of bounded size, whose error in rank is known; so for each quantile there are two values that it lies between for sure, with few values of a
large group between them. A second pass counts the values in between one by one and all others in bulk; running counts in order give the wanted ranks.
No task has more of a group than its values between the bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups up to SMALL values are counted whole; in larger ones the sketch is off by a ten-thousandth of their ranks at most.
SMALL, ACCURACY = 100_000, 10_000


def quantiles(df: DataFrame, value: str, groups: list[str], at: dict[str, float]) -> DataFrame:
    """groups and a column for each of at (name to share): the linear quantile of value, as a double. Null values do not count; a null group is a group."""
    g, q = list(groups), sorted(at.values())
    keys = [f"__g{k}" for k in range(len(g))]
    some = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(g, keys, strict=True)], F.col(value).cast("double").alias("__v"))
    bounds = [min(max(p + s * 2 / ACCURACY, 0.0), 1.0) for p in q for s in (-1, 1)]
    ends = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.percentile_approx("__v", bounds, ACCURACY).alias("__b"))
    whole = F.array(*[F.col(c) for _ in q for c in ("__lo", "__hi")])
    ends = ends.select(*keys, "__n", F.when(F.col("__n") <= SMALL, whole).otherwise(F.col("__b")).alias("__b"))
    named = ends.withColumnsRenamed({k: f"{k}e" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}e")) for k in keys]) if keys else None
    placed = some.join(named, same) if keys else some.crossJoin(F.broadcast(named))  # one row of ends
    low, high = [F.col("__b")[2 * k] for k in range(len(q))], [F.col("__b")[2 * k + 1] for k in range(len(q))]
    v = F.col("__v")
    between = reduce(lambda a, b: a | b, [(v >= a) & (v <= b) for a, b in zip(low, high, strict=True)])
    # Bounds that a value has passed: grows with the value, so values out of reach are one row between two bounds.
    passed = reduce(lambda a, b: a + b, [x.cast("int") for a, b in zip(low, high, strict=True) for x in (v >= a, v > b)])
    counted = placed.groupBy(*keys, "__n", passed.alias("__p"), F.when(between, v).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = counted.withColumn("__upto", F.sum("__c").over(W.partitionBy(*keys).orderBy("__p", "__v")))
    place = {name: F.lit(p) * (F.col("__n") - 1) for name, p in at.items()}
    ranked = [F.min(F.when(F.col("__upto") > f(x), F.col("__v"))).alias(f"{name}{s}") for name, x in place.items() for s, f in (("__0", F.floor), ("__1", F.ceil))]
    out = upto.groupBy(*keys, "__n").agg(*ranked)
    value_of = lambda name, x: F.col(f"{name}__0") + (F.col(f"{name}__1") - F.col(f"{name}__0")) * (x - F.floor(x))
    return out.select(*[F.col(k).alias(c) for c, k in zip(g, keys, strict=True)], *[value_of(name, x).alias(name) for name, x in place.items()])


def with_medians(df: DataFrame, values: list[str], groups: list[str]) -> DataFrame:
    """groups and the median of each of values under its own name."""
    g = list(groups)
    parts = [quantiles(df, v, g, {v: 0.5}) for v in values]
    out = parts[0]
    for p in parts[1:]:
        p = p.withColumnsRenamed({c: f"__{c}" for c in g})
        out = out.join(p, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g])).drop(*[f"__{c}" for c in g])
    return out
