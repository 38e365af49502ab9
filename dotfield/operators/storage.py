"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine a folder of our own where it is unset, on a cluster an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table, in folders by a column if one is given: cuts lineage, survives lost executors, keeps column pruning."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if by:
        df.repartition(by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how) of two sides that are never broadcast.

    Spark guesses a side's size by that of its files: rows that are exploded and columns that hardly take room in Parquet do not count
    there, so a table of gigabytes would go through the driver.
    """
    return left.join(right.hint("merge"), on, how)
