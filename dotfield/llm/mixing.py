"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997).

A source with target T and size S takes each of its documents floor(T / S) times for certain. The rest of the target is a
sample of fixed size, without replacement and with unequal probabilities. Documents of a source fall into strata of size
(a factor of 1.25 each). The rest is shared among strata so that inclusion grows with the square root of the size, as
longer texts bring more words for their share of repeats, until a stratum is taken whole. Each stratum's share makes a number n of
documents, rounded so that the strata's words together come to the rest. In a stratum of N documents and f = n / N a
document of size s has the inclusion probability p = f + f (1 - f) g (s / mean - 1), which sums to n and stays within 0 and 1;
an optional weight of the document multiplies s, and g <= 1 keeps p below 1. Documents are ranked by random odds over
inclusion odds, u / (1 - u) : p / (1 - p), and the n of lowest rank are taken. u is a hash of the id, so reruns agree.

No task sorts a source or stratum: ranks are cut into fixed bins, counted per (source, stratum, bin), and only the bin in
which n is reached is ordered row by row. That gives a rank for each stratum up to which documents are taken, and this small table decides for every
row by itself; rows are not joined to rows.

Cases. Null or empty texts have size 0 and are taken whole copies only, as 0 words. A null source is a source of its own,
last. Sources without words have target 0. Rows that repeat an id are drawn alike, told apart by size; rows that tie at a stratum's last
rank are taken together. A very long text is a stratum like any other. An empty table gives an empty table. Further columns, of any name, stay with mixed_rows().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, small_or_shuffled, written

BINS = 16_384
STRATUM = 1.25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def filled(rows: DataFrame, by: list[str], order: list[Column], cap: Column, weight: Column, total: Column) -> DataFrame:
    """rows with amount: total, shared within each `by` in proportion to weight, each row's amount stopping at cap.

    The level c at which min(cap, c * weight) sums to the total is found by running sums in order of cap over weight.
    """
    rows = rows.withColumns({"__cap": cap.cast("double"), "__w": weight.cast("double"), "__total": total.cast("double")})
    filling = W.partitionBy(*by).orderBy(F.col("__cap") / F.col("__w"), *order)
    every, before = W.partitionBy(*by), filling.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"__w_all": F.sum("__w").over(every), "__full": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)), "__w_full": F.coalesce(F.sum("__w").over(before), F.lit(0.0)), "__at": F.row_number().over(filling)})
    level = (F.col("__total") - F.col("__full")) / (F.col("__w_all") - F.col("__w_full"))
    # The first row in this order that is not filled sets the level for all after it.
    first = F.min(F.when(level * F.col("__w") <= F.col("__cap"), F.struct("__at", level.alias("level")))).over(every)
    rows = rows.withColumn("__level", first["level"])
    amount = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__level") * F.col("__w")))
    return rows.withColumn("amount", amount).drop("__cap", "__w", "__total", "__w_all", "__full", "__w_full", "__at", "__level")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from a table of (source, source_size), one row per source.

    Sources by code point, null last, weigh `weights`, repeating; together they get share times all sizes. A target stops at
    most times its source's size, and the excess is shared again by weight until none is above.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("__weight"), F.sum("source_size").over(W.partitionBy()).alias("__all"))
    s = filled(s, [], [F.col("source").isNull(), F.col("source")], F.col("source_size") * F.lit(float(most)), F.col("__weight"), F.col("__all") * F.lit(float(share)))
    return s.select("source", "source_size", F.col("amount").alias("target"))


def _stratum(size: Column) -> Column:
    """The size's stratum; null without words."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.lit(math.log(STRATUM)) + 1e-9)).cast("int")


def _rank() -> Column:
    """Random odds over inclusion odds, for rows with __u, __h and their stratum's f, g and mean_h."""
    p = F.col("f") + F.col("f") * (1 - F.col("f")) * F.col("g") * (F.try_divide(F.col("__h"), F.col("mean_h")) - 1)
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return (F.col("__u") / (1 - F.col("__u"))) / (p / (1 - p))


def sized(rows: DataFrame, doc_id: Column, source: Column, text: Column, weight: Column | None, seed: str) -> DataFrame:
    """rows with what a draw needs: size, stratum, __h (size times weight), __u and __source."""
    rows = rows.withColumns({"size": word_count(text), "__u": uniform(doc_id, seed), "__source": source, "__dw": F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))})
    return rows.withColumns({"stratum": _stratum(F.col("size")), "__h": F.col("size") * F.col("__dw")})


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's and stratum's plan. Plans have one row per stratum of a source: some dozen for each source."""
    plan = plan.select(F.col("source").alias("__s"), F.col("stratum").alias("__t"), *[c for c in plan.columns if c not in ("source", "stratum")])
    small = small_or_shuffled(plan, plan.count())
    return rows.join(small, F.col("__source").eqNullSafe(F.col("__s")) & F.col("stratum").eqNullSafe(F.col("__t")), "left").drop("__s", "__t")


def shares(strata: DataFrame, goal: DataFrame) -> DataFrame:
    """The plan (source, stratum, source_size, target, sure, n, f, g, mean_h) of strata (source, stratum, docs, words, h, h_words, h_most)."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = strata.withColumnRenamed("source", "__s").join(goal, F.col("__s").eqNullSafe(F.col("source"))).drop("__s").withColumn("sure", F.floor(ratio + 1e-12).cast("long"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("sure") * F.col("source_size"))
    real = plan.filter("stratum is not null")
    real = filled(real, ["source"], [F.col("stratum")], F.col("words"), F.col("words") * F.sqrt(F.col("words") / F.col("docs")), rest)
    mean, tilt = F.col("words") / F.col("docs"), F.col("h_words") / F.col("h") - F.col("words") / F.col("docs")
    f = F.col("amount") / F.col("words")
    # Words that a drawn document brings on average, as larger ones are likelier.
    real = real.withColumn("__each", mean + (1 - f) * F.least(F.lit(1.0), 1 / (f * (F.col("h_most") * F.col("docs") / F.col("h") - 1) + 1e-12)) * tilt)
    order = real.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("stratum", "docs", "amount", "__each")), asc=False).alias("__all"))

    def step(acc: Column, x: Column) -> Column:
        want = x["amount"] + acc["carry"]
        n = F.least(F.greatest(F.floor(want / x["__each"] + 0.5), F.lit(0)), x["docs"]).cast("long")
        return F.struct((want - n * x["__each"]).cast("double").alias("carry"), F.concat(acc["out"], F.array(F.struct(x["stratum"].alias("stratum"), n.alias("n")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<stratum:int,n:bigint>>").alias("out"))
    drawn = order.select(F.col("source").alias("__s"), F.explode(F.aggregate("__all", start, step)["out"]).alias("__n")).select("__s", F.col("__n.stratum").alias("__t"), F.col("__n.n").alias("n"))
    plan = plan.join(drawn, F.col("source").eqNullSafe(F.col("__s")) & (F.col("stratum") == F.col("__t")), "left").drop("__s", "__t").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    f = F.col("n") / F.col("docs")
    g = F.least(F.lit(1.0), 1 / (f * (F.try_divide(F.col("h_most") * F.col("docs"), F.col("h")) - 1) + 1e-12))
    return plan.select("source", "stratum", "source_size", "target", "sure", "n", "docs", f.alias("f"), F.coalesce(g, F.lit(1.0)).alias("g"), (F.col("h") / F.col("docs")).alias("mean_h"))


def cuts(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with cut: the rank up to which a stratum's documents are taken, n of them."""
    some = _with_plan(slim, plan.filter("n > 0 and n < docs")).filter("n is not null").select("__source", "stratum", "n", _rank().alias("rank"))
    some = some.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    some = written(some, "mix-ranks")
    bins = some.groupBy("__source", "stratum", "n", "bin").agg(F.count(F.lit(1)).alias("k"))
    bins = bins.withColumn("upto", F.sum("k").over(W.partitionBy("__source", "stratum").orderBy("bin")))
    edge = written(bins.filter((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("k") < F.col("n"))).select(F.col("__source").alias("__s"), F.col("stratum").alias("__t"), F.col("bin").alias("__b"), (F.col("n") - F.col("upto") + F.col("k")).alias("__left")), "mix-edges")
    last = some.join(small_or_shuffled(edge, edge.count()), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("stratum") == F.col("__t")) & (F.col("bin") == F.col("__b")))
    last = last.withColumn("__at", F.row_number().over(W.partitionBy("__source", "stratum").orderBy("rank"))).filter(F.col("__at") == F.col("__left"))
    last = last.select("__s", "__t", F.col("rank").alias("cut"))
    out = plan.join(last, F.col("source").eqNullSafe(F.col("__s")) & (F.col("stratum") == F.col("__t")), "left").drop("__s", "__t")
    return out.withColumn("cut", F.when(F.col("n") == 0, F.lit(-1.0)).when(F.col("n") == F.col("docs"), F.lit(math.inf)).otherwise(F.col("cut")))


def planned(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """The whole plan (a written table) for sized documents."""
    strata = written(slim.groupBy(F.col("__source").alias("source"), "stratum").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words"), F.sum("__h").cast("double").alias("h"), F.sum(F.col("__h") * F.col("size")).cast("double").alias("h_words"), F.max("__h").cast("double").alias("h_most")), "mix-strata")
    goal = written(targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")
    plan = written(shares(strata, goal), "mix-shares")
    return written(cuts(slim, plan), "mix-plan")


def _copies() -> Column:
    return F.col("sure") + F.coalesce(_rank() <= F.col("cut"), F.lit(False)).cast("long")


def mix(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", weight: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words), copies, and source.

    weight: a column of positive numbers that raise or lower a document's inclusion within its stratum.
    """
    doc_weight = F.col(f"`{weight}`") if weight else None
    docs = documents.select("doc_id", "source", "text", *([doc_weight.alias("__weight")] if weight else []))
    slim = sized(docs, F.col("doc_id"), F.col("source"), F.col("text"), F.col("__weight") if weight else None, seed)
    slim = written(slim.select("doc_id", "__source", "size", "stratum", "__h", "__u"), "mix-sizes")
    rows = _with_plan(slim, planned(slim, weights, share, most))
    copies = _copies()
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("__source").alias("source"))


def mixed_rows(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """documents with each row as often as the mix takes it; documents without words stay once."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = sized(rows, F.col("row.doc_id"), F.col("row.source"), F.col("row.text"), None, seed)
    slim = written(rows.select("__source", "size", "stratum", "__h", "__u"), "mix-sizes")
    rows = _with_plan(rows, planned(slim, weights, share, most))
    copies = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(_copies())
    return rows.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("row.*")
