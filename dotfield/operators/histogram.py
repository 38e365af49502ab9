"""Bins, their peaks, summaries and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def log_bins(df: DataFrame, value: str, groups: list[str] = (), bins: int = 69) -> DataFrame:
    """groups, bin, low, high, n: bins of equal width in log10 between the least and largest positive value.

    The last bin includes the largest value. Empty bins have no row.
    """
    g = list(groups)
    pos = df.filter(F.col(value) > 0).select(*g, F.log10(value).alias("__v"))
    ends = pos.groupBy(*g).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    placed = pos.join(ends, g) if g else pos.crossJoin(F.broadcast(ends))  # one row of ends
    width = (F.col("__hi") - F.col("__lo")) / bins
    placed = placed.withColumn("bin", F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int"))
    counted = placed.groupBy(*g, "bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.pow(F.lit(10.0), F.col("__lo") + k * width)
    return counted.select(*g, "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")


def auto_bins(df: DataFrame, value: str, groups: list[str] = ()) -> DataFrame:
    """groups, bin, low, high, n with the smaller of Sturges' and Freedman-Diaconis' widths."""
    g = list(groups)
    some = df.filter(F.col(value).isNotNull()).select(*g, F.col(value).cast("double").alias("__v"))
    ends = some.groupBy(*g).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    quarters = quantiles(some, "__v", g, {"__q1": 0.25, "__q3": 0.75})
    ends = ends.join(quarters, g) if g else ends.crossJoin(F.broadcast(quarters))  # single rows
    span = F.col("__hi") - F.col("__lo")
    sturges = span / (F.log2(F.col("__n").cast("double")) + 1)
    diaconis = 2 * (F.col("__q3") - F.col("__q1")) / F.pow(F.col("__n").cast("double"), F.lit(1 / 3))
    width = F.when(diaconis > 0, F.least(sturges, diaconis)).otherwise(sturges)
    ends = ends.select(*g, "__lo", "__hi", F.when(span > 0, F.greatest(F.ceil(span / width), F.lit(1))).otherwise(1).cast("int").alias("__bins"))
    placed = some.join(ends, g) if g else some.crossJoin(F.broadcast(ends))  # one row of ends
    step = span / F.col("__bins")
    placed = placed.withColumn("bin", F.when(span > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / step), F.col("__bins") - 1)).otherwise(0).cast("int"))
    counted = placed.groupBy(*g, "bin", "__lo", "__hi", "__bins").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*g, "bin", (F.col("__lo") + F.col("bin") * step).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * step).alias("high"), "n")


def peak(bins: DataFrame, groups: list[str] = ()) -> DataFrame:
    """The fullest bin of each group, the first of equals: groups, low, high, n."""
    best = bins.groupBy(*groups).agg(F.max(F.struct("n", (-F.col("bin")).alias("k"), "low", "high")).alias("b"))
    return best.select(*groups, F.col("b.low").alias("low"), F.col("b.high").alias("high"), F.col("b.n").alias("n"))


def summary(df: DataFrame, value: str, groups: list[str], log: bool = False) -> DataFrame:
    """groups, n, mean, population std, median and the peak bin as an interval; log: positive values, log bins."""
    some = df.filter(F.col(value).isNotNull() & ((F.col(value) > 0) if log else F.lit(True)))
    stats = some.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    stats = stats.join(quantiles(some, value, groups, {"median": 0.5}), groups)
    bins = log_bins(some, value, groups) if log else auto_bins(some, value, groups)
    top = peak(bins, groups).select(*groups, F.col("low").alias("peak_low"), F.col("high").alias("peak_high"))
    return stats.join(top, groups)


def grid(df: DataFrame, size: int, groups: list[str] = ()) -> DataFrame:
    """df with xb and yb, equal cells 1 to size between least and largest x and y of the group; the largest is in none."""
    g = list(groups)
    ends = df.groupBy(*g).agg(F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.min("y").alias("__y0"), F.max("y").alias("__y1"))
    placed = df.join(ends, g) if g else df.crossJoin(F.broadcast(ends))  # one row of ends
    at = lambda c: (F.floor((F.col(c) - F.col(f"__{c}0")) / (F.col(f"__{c}1") - F.col(f"__{c}0")) * size) + 1).cast("int")
    placed = placed.filter((F.col("__x1") > F.col("__x0")) & (F.col("__y1") > F.col("__y0")))
    return placed.withColumns({"xb": at("x"), "yb": at("y")}).filter((F.col("xb") <= size) & (F.col("yb") <= size)).drop("__x0", "__x1", "__y0", "__y1")


def density(df: DataFrame, size: int, groups: list[str] = ()) -> DataFrame:
    return grid(df, size, groups).groupBy(*groups, "xb", "yb").agg(F.count(F.lit(1)).alias("n")).withColumn("log_density", F.log1p("n"))


def density_summary(df: DataFrame, size: int, groups: list[str]) -> DataFrame:
    """mean, population std and median of the counts of all size * size cells, empty ones too, from the full ones alone."""
    full = density(df, size, groups).select(*groups, "n")
    cells = size * size
    w = W.partitionBy(*groups).orderBy("n")
    ranked = full.groupBy(*groups, "n").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(w))
    each = W.partitionBy(*groups)
    ranked = ranked.withColumn("zero", cells - F.sum("c").over(each))
    # The k-th smallest (from 1) is 0 up to the empty cells, then the first count whose running number reaches it.
    at = lambda k: F.coalesce(F.min(F.when(F.col("zero") + F.col("upto") >= k, F.col("n"))), F.lit(0))
    out = ranked.groupBy(*groups, "zero").agg(F.sum(F.col("n") * F.col("c")).alias("s"), F.sum(F.col("n") * F.col("n") * F.col("c")).alias("ss"), at((cells + 1) // 2).alias("m1"), at(cells // 2 + 1).alias("m2"))
    low = lambda c, k: F.when(F.col("zero") >= k, 0).otherwise(F.col(c))
    mean = F.col("s") / F.lit(float(cells))
    return out.select(*groups, mean.alias("mean"), F.sqrt(F.col("ss") / F.lit(float(cells)) - mean * mean).alias("std"), ((low("m1", (cells + 1) // 2) + low("m2", cells // 2 + 1)) / F.lit(2.0)).alias("median"))


def count_density(df: DataFrame, size: int, groups: list[str], bins: int = 30) -> DataFrame:
    """groups, bin, low, high, density: of the counts of all size * size cells, empty ones too, in bins of equal width whose densities times widths sum to 1.

    The last bin has its upper end; if all counts are equal the bins span one around them. Bins without a cell have no row.
    """
    g = list(groups)
    per = density(df, size, g).groupBy(*g, F.col("n").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    zero = per.groupBy(*g).agg((F.lit(size * size) - F.sum("c")).alias("c")).filter("c > 0").select(*g, F.lit(0).cast("long").alias("v"), "c")
    per = per.unionByName(zero)
    ends = per.groupBy(*g).agg(F.min("v").cast("double").alias("__lo"), F.max("v").cast("double").alias("__hi"))
    ends = ends.select(*g, *[F.when(F.col("__lo") == F.col("__hi"), F.col(c) + d).otherwise(F.col(c)).alias(c) for c, d in (("__lo", -0.5), ("__hi", 0.5))])
    placed = per.join(ends, g) if g else per.crossJoin(F.broadcast(ends))  # one row of ends
    width = (F.col("__hi") - F.col("__lo")) / bins
    placed = placed.withColumn("bin", F.least(F.floor((F.col("v") - F.col("__lo")) / width), F.lit(bins - 1)).cast("int"))
    out = placed.groupBy(*g, "bin", "__lo", "__hi").agg(F.sum("c").alias("c"))
    return out.select(*g, "bin", (F.col("__lo") + F.col("bin") * width).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * width).alias("high"), (F.col("c") / (F.lit(float(size * size)) * width)).alias("density"))


def otsu(df: DataFrame, value: str, groups: list[str] = (), bins: int = 256) -> DataFrame:
    """groups, threshold: the centre of the histogram bin that splits values with the largest variance between classes."""
    g = list(groups)
    some = df.filter(F.col(value).isNotNull()).select(*g, F.col(value).alias("__v"))
    ends = some.groupBy(*g).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    placed = some.join(ends, g) if g else some.crossJoin(F.broadcast(ends))  # one row of ends
    width = (F.col("__hi") - F.col("__lo")) / bins
    placed = placed.withColumn("bin", F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(0))
    rows = placed.groupBy(*g, "bin", "__lo", "__hi").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = rows.withColumn("mid", F.col("__lo") + (F.col("bin") + 0.5) * width)
    every, upto = W.partitionBy(*g), W.partitionBy(*g).orderBy("bin")
    rows = rows.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("mid")).over(upto), "w": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("mid")).over(every)})
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    rows = rows.withColumn("between", F.when(F.col("w") > F.col("w0"), F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap).otherwise(0.0))
    best = rows.groupBy(*g).agg(F.max(F.struct("between", (-F.col("bin")).alias("k"), "mid")).alias("b"))
    return best.select(*g, F.col("b.mid").alias("threshold"))
