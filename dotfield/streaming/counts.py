"""Filter counts and windowed counts over a stream of localizations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Limits
from ..operators.storage import shared_dir


def filtered_stream(stream: DataFrame, limits: Limits) -> DataFrame:
    """The rows that pass; the running counts of each step are observed metrics named filter_counts."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("rows")]
    for name, _, p in limits.steps(stream.columns):
        if p is not None:
            passed = passed & F.coalesce(p, F.lit(False))
            counts.append(F.count_if(passed).alias(name))
    return stream.observe("filter_counts", *counts).filter(passed)


def density_stream(stream: DataFrame, time: str, late: str, width: str, cell: float, groups: list[str] = ()) -> DataFrame:
    """Counts per time window, group and grid cell; rows later than `late` are left out."""
    at = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *groups, at("x").alias("xb"), at("y").alias("yb")).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, as a written table: the query runs until its source is used up, with its checkpoint in the shared folder.

    Of windows that are still open nothing is written; so a stream of files that ends gives whole windows alone.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
