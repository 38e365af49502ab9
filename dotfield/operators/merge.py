"""Summaries of many experiments as one table: lineage, unlike columns, joins by place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import columns_alike


def stacked(tables: dict[str, DataFrame], lineage: str = "source") -> DataFrame:
    """All rows with the name of their table; columns that a table lacks are null."""
    parts = [df.withColumn(lineage, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coalesced_alike(df: DataFrame) -> DataFrame:
    """Columns whose names differ by a -1, -2 or -3 become one, the first value present."""
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in same]).alias(name) for name, same in columns_alike(df.columns).items()])


def by_place(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str], columns: list[str]) -> DataFrame:
    """left with columns of the right row at the same place in its group of key; null where right has fewer rows."""
    at = lambda order: F.row_number().over(W.partitionBy(key).orderBy(*order))
    r = right.select(key, at(right_order).alias("__place"), *columns)
    return left.withColumn("__place", at(left_order)).join(r, [key, "__place"], "left").withColumnRenamed("__place", "place")


def first_by_name(df: DataFrame, names: DataFrame, df_key: str, name_key: str, order: str) -> DataFrame:
    """df with the first row of names whose trimmed name equals the trimmed key."""
    first = names.withColumn("__k", F.trim(name_key)).withColumn("__r", F.row_number().over(W.partitionBy("__k").orderBy(order))).filter("__r = 1").drop("__r")
    return df.withColumn("__k", F.trim(df_key)).join(first, "__k", "left").drop("__k")


def merged(stats: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Rows without noise per combination of keys is a filter of one table, not a file: here the counts of what each holds."""
    kept = stats.filter("cluster <> -1") if "cluster" in stats.columns else stats
    return {"rows": kept, "counts": kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))}


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, a, b (the first name of each side by key) and side: both, only_a or only_b. a and b have key and name."""
    first = lambda df, s: df.groupBy(key).agg(F.min("name").alias(s))
    side = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
    return first(a, "a").join(first(b, "b"), key, "full").select(key, "a", "b", side.alias("side"))


def distribution(files: DataFrame, group: str, item: str) -> DataFrame:
    """How many groups have how many items: group, n."""
    return files.groupBy(group).agg(F.countDistinct(item).alias("n"))


def folded(report: DataFrame, key: list[str]) -> DataFrame:
    """Of step reports (key, step, status): the lists of applied, disabled and skipped steps."""
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("step"))))
    return report.groupBy(*key).agg(of("applied").alias("applied"), of("disabled").alias("disabled"), of("missing_columns").alias("skipped"))
