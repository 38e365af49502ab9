"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffled, written

#: With more edges (both ways) than this their tables are never broadcast.
BROADCAST = 1_000_000


def components(edges: DataFrame, groups: list[str] = (), rounds: int = 60) -> DataFrame:
    """groups, node, root (the smallest node of its component) for the nodes of edges (groups, i, j).

    In a round a node takes the smallest root among its neighbours, tells it to its old root, and then takes the root of its
    root; a chain of n nodes settles in about log n rounds. Each round is a written table.
    """
    g = list(groups)
    both = edges.select(*g, "i", "j").unionByName(edges.select(*g, F.col("j").alias("i"), F.col("i").alias("j")))
    both = written(both.distinct(), "edges")
    met, leaves = DataFrame.join, None
    if both.count() > BROADCAST:
        # A node whose one neighbour is smaller has its neighbour's root: it is left out of the rounds.
        met = shuffled
        one = both.groupBy(*g, F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("j").alias("hub"))
        leaves = written(one.filter("n = 1 and hub < node").select(*g, "node", "hub"), "leaves")
        for end in "ij":
            both = shuffled(both, leaves.select(*g, F.col("node").alias(end)), [*g, end], "left_anti")
        both = written(both, "edges")

    def whole(roots: DataFrame) -> DataFrame:
        if leaves is None:
            return roots
        told = shuffled(leaves, roots.select(*g, F.col("node").alias("hub"), "root"), [*g, "hub"], "left").select(*g, "node", "hub", F.coalesce("root", "hub").alias("root"))
        alone = shuffled(leaves.select(*g, F.col("hub").alias("node")).distinct(), roots, [*g, "node"], "left_anti").withColumn("root", F.col("node"))
        return written(roots.unionByName(told.drop("hub")).unionByName(alone), "roots")

    # The first round needs no join: a node's root is the smallest of itself and its neighbours.
    roots = both.groupBy(*g, F.col("i").alias("node")).agg(F.least(F.first("i"), F.min("j")).alias("root"))
    roots = written(roots.withColumn("moved", F.col("root") != F.col("node")), "roots")
    for _ in range(rounds):
        if roots.filter("moved").isEmpty():
            return whole(roots.drop("moved"))
        now = roots.select(*g, "node", "root")
        told = met(both, now.withColumnRenamed("node", "j"), [*g, "j"]).groupBy(*g, F.col("i").alias("node")).agg(F.min("root").alias("near"))
        told = met(now, told, [*g, "node"]).select(*g, "node", "root", F.least("root", "near").alias("near"))
        hooks = told.select(*g, F.col("root").alias("node"), F.lit(None).cast(dict(now.dtypes)["root"]).alias("root"), "near")
        new = told.unionByName(hooks).groupBy(*g, "node").agg(F.max("root").alias("__old"), F.min("near").alias("root"))
        # A root's own root is its smallest one: follow it once.
        new = met(new, now.select(*g, F.col("node").alias("root"), F.col("root").alias("__next")), [*g, "root"], "left")
        new = new.select(*g, "node", F.least("root", F.coalesce("__next", "root")).alias("root"), "__old")
        roots = written(new.select(*g, "node", "root", (F.col("root") != F.col("__old")).alias("moved")), "roots")
    raise RuntimeError("components did not settle")
