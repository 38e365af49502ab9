"""Gapless numbers in an order, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKS = 1024


def numbered(df: DataFrame, groups: list[str], by: str, name: str, then: list[str] = ()) -> DataFrame:
    """df with name: 1, 2, ... in each group by the number `by`, then by `then`.

    The span of `by` is cut into blocks. Blocks are counted, the counts summed in order, and rows numbered in their block; so
    a task has some of a group's rows, unless they are alike in `by`.
    """
    g = list(groups)

    def met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:  # a null group is a group
        table = table.withColumnsRenamed({c: f"__{c}" for c in keys})
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
        return (rows.join(table, reduce(lambda a, b: a & b, on)) if on else rows.crossJoin(table)).drop(*[f"__{c}" for c in keys])

    ends = df.groupBy(*g).agg(F.min(by).cast("double").alias("__lo"), F.max(by).cast("double").alias("__hi"))
    cut = met(df, F.broadcast(ends), g)  # a row per group
    step = F.greatest((F.col("__hi") - F.col("__lo")) / F.lit(float(BLOCKS)), F.lit(1.0))
    cut = cut.withColumn("__block", F.floor((F.col(by).cast("double") - F.col("__lo")) / step).cast("int")).drop("__lo", "__hi")
    before = cut.groupBy(*g, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select(*g, "__block", (F.sum("__n").over(W.partitionBy(*g).orderBy("__block")) - F.col("__n")).alias("__before"))
    here = F.row_number().over(W.partitionBy(*g, "__block").orderBy(by, *then))
    before = before.withColumnRenamed("__block", "block")
    out = met(cut.withColumn("__here", here).withColumnRenamed("__block", "block"), before, [*g, "block"])
    return out.withColumn(name, (F.col("__before") + F.col("__here")).cast("long")).drop("block", "__here", "__before")
