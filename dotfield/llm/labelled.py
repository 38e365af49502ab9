"""Bounded samples of labelled documents; the held-out fold is never among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, small_or_shuffled


def _known(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    known = crc_fold(documents.sparkSession, labels.select("doc_id", F.col(label).cast("int").alias("label")), "doc_id").filter("doc_id is not null and label is not null and not held_out")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def shares(documents: DataFrame, labels: DataFrame, label: str) -> dict[int, int]:
    """How many documents outside the held-out fold each label has."""
    return {r.label: r.n for r in _known(documents, labels, label).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def sample(documents: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """doc_id, text, label: for each label at most most[label] documents outside the held-out fold, in order of a hash of the id.

    A null label or id is left out; of several labels of one id the largest counts, and of several texts one.
    """
    known = _known(documents, labels, label).withColumn("__h", F.xxhash64("doc_id"))
    parts = [known.filter(F.col("label") == v).orderBy("__h", "doc_id").limit(n).select("doc_id", "label") for v, n in sorted(most.items())]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    texts = documents.select("doc_id", "text").join(small_or_shuffled(chosen, sum(most.values())), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.max("text").alias("text"))
