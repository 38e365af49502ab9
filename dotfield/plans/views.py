"""The given tables seen as localizations, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("loc_id"), F.col("value").alias("x"), (F.col("user_id") * 10.0).cast("double").alias("y"), hours.cast("int").alias("frame"), F.col("event_type").alias("channel"))


def vectors(spark: SparkSession, sf_dir: str, deep: bool = False) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double") * 1000.0
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("loc_id"), at(0).alias("x"), at(1).alias("y"), *([at(2).alias("z")] if deep else []), (F.col("label") % 2).cast("int").alias("channel"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("l_shipdate").cast("timestamp_ntz").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 100).alias("y"), days.alias("frame"), F.col("l_returnflag").alias("channel"),
        F.col("l_extendedprice").alias("photons"), F.col("l_quantity").alias("sx"), (F.col("l_quantity") + 4.0).alias("sy"), (F.col("l_discount") * 100 + 0.0).alias("lp"), (F.col("l_tax") + 0.0).alias("pvalue"),
    )


LE = "le AS (SELECT event_id AS loc_id, value AS x, CAST(user_id * 10 AS DOUBLE) AS y, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS frame, event_type AS channel FROM events)"
LV = "lv AS (SELECT vec_id AS loc_id, 1000.0::DOUBLE * CAST(embedding[1] AS DOUBLE) AS x, 1000.0::DOUBLE * CAST(embedding[2] AS DOUBLE) AS y, CAST(label % 2 AS INTEGER) AS channel FROM embeddings)"
LL = "ll AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x, l_quantity * 100 AS y, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame, l_returnflag AS channel, l_extendedprice AS photons, l_quantity AS sx, l_quantity + 4.0::DOUBLE AS sy, l_discount * 100 + 0.0::DOUBLE AS lp, l_tax + 0.0::DOUBLE AS pvalue FROM lineitem)"
