"""Exact deduplication by content-defined chunk recipes.

A text without its whitespace is cut where a rolling hash of its last 32 bytes has zero low bits, so equal passages are
cut alike. A chunk's identifier is a keyed 128-bit digest. A pass over the distinct (identifier, chunk) pairs verifies that
no identifier names two chunks; it stops the job if one does, and another key cures that. Texts are then equal exactly
when their ordered identifier lists are equal, so groups are formed from the short lists and long texts are not moved
again.

Cases. Null counts as empty; all empty texts are one group. A null id sorts after all others. Rows repeated with their
id are all members, and all marked kept if that id stays. Very long texts give long lists, in bounded chunks. An empty
table gives an empty table. Further columns are not read by the digest and are kept by deduplicated().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, arrow_map, without, written

WINDOW = 32
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 256, 10, 16_384
_DELETE = WS.encode()
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data, the last one len(data): at least MIN_CHUNK (but for the last), at most MAX_CHUNK bytes."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # a hash of the last 2 * step bytes from two of step bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    hits = np.flatnonzero((h[WINDOW:] >> np.uint32(32 - MASK_BITS)) == 0) + WINDOW + 1
    ends, last = [], 0
    for e in hits.tolist():
        if e - last < MIN_CHUNK:
            continue
        while e - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if e - last >= MIN_CHUNK:
            ends.append(e)
            last = e
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks_of(text: bytes | None) -> tuple[bytes, list[bytes]]:
    data = (text or b"").translate(None, _DELETE)
    last, out = 0, []
    for e in cut_points(data):
        out.append(data[last:e])
        last = e
    return data, out


def recipes(documents: DataFrame, key: bytes = b"dotfield") -> DataFrame:
    """doc_id, text_key, points (code points of the original text), text_sha256, recipe (ordered 16-byte chunk identifiers)."""

    def make():
        def f(b: pa.RecordBatch):
            points, sha, ids = [], [], []
            for t in b.column(2).to_pylist():
                data, parts = chunks_of(t)
                points.append(len(t.decode("utf-8", "replace")) if t else 0)
                sha.append(hashlib.sha256(data).hexdigest())
                ids.append([hashlib.blake2b(p, digest_size=16, key=key).digest() for p in parts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(points, pa.int64()), pa.array(sha, pa.string()), pa.array(ids, pa.list_(pa.binary()))], ["doc_id", "text_key", "points", "text_sha256", "recipe"])

        return f

    return arrow_map(documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary")), "doc_id long, text_key long, points long, text_sha256 string, recipe array<binary>", make)


def chunk_store(documents: DataFrame, key: bytes = b"dotfield") -> DataFrame:
    """The distinct (id, chunk) pairs of all documents; repeats go before the shuffle."""

    def make():
        def f(b: pa.RecordBatch):
            seen = {}
            for t in b.column(0).to_pylist():
                for p in chunks_of(t)[1]:
                    seen[p] = None
            parts = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(p, digest_size=16, key=key).digest() for p in parts], pa.binary()), pa.array(parts, pa.binary())], ["id", "chunk"])

        return f

    return arrow_map(documents.select(F.col("text").cast("binary")), "id binary, chunk binary", make).distinct()


def verify(documents: DataFrame, key: bytes = b"dotfield") -> None:
    """Compare chunk contents: an identifier with two different chunks stops the job."""
    clash = chunk_store(documents, key).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if clash.limit(1).count():
        raise ValueError("a chunk identifier names two chunks; choose another key")


def decided(documents: DataFrame, key: bytes = b"dotfield") -> DataFrame:
    """One row per document: doc_id, text_key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest doc_id.
    """
    verify(documents, key)
    rows = written(recipes(documents, key), "recipes")
    # As a string the ordered list is one value that Spark compares, hashes and sorts at once.
    rows = rows.withColumn("recipe", F.concat_ws("", F.transform("recipe", lambda x: F.hex(x))))
    most = rows.groupBy("recipe").agg(F.max("points").alias("points"), F.count(F.lit(1)).alias("group_size"))
    best = rows.groupBy("recipe", "points").agg(F.min("doc_id").alias("keep_id"))
    groups = best.join(most, ["recipe", "points"]).select("recipe", "keep_id", "group_size", F.col("points").alias("__most"))
    out = rows.join(groups, "recipe")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("__most"))
    return out.select("doc_id", "text_key", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def exact_groups(documents: DataFrame, key: bytes = b"dotfield") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return decided(documents, key).drop("text_key")


def deduplicated(documents: DataFrame, key: bytes = b"dotfield") -> DataFrame:
    """The rows of documents that stay, with all their columns. Rows alike in id and text stay or go together."""
    return without(documents, decided(documents, key).filter(~F.col("kept")), "dropped-copies")
