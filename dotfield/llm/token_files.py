"""Token ids in files of patched frame-of-reference blocks.

A file holds whole documents in ascending order of id:

    magic "PFR1", then little-endian: u32 task, u32 number, u32 documents, u64 ids, u32 ids in a block
    i64 id of each document (the least i64 for null), u32 length of each document
    u32 start of each block in the bytes that follow, and their end
    blocks: u32 minimum, u8 width, u16 exceptions, packed differences, u16 places and u32 values of the exceptions

In a block the minimum is subtracted and the differences are packed, high bit first, at the width of the 90th percentile;
larger ones are kept as exceptions. Block starts give access to any block without reading those before it.

Tasks give one row of bytes per file, and Spark's text writer puts each row into a file of its own (and a line's end
after it, which the format allows); the binaryFile source reads them back. So any file system that Spark knows will do.

Cases. Null counts as empty: the end id alone. Repeated rows and null ids are documents of their own, null ids first. A
text longer than a file's usual size is one file. An empty table gives no file and an empty table. Further columns are
not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, new_path, written
from .tokens import MOST, STEP, encoder, load

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIIQI")
BLOCK_HEAD = struct.Struct("<IBH")
BLOCK, PERCENT = 256, 90
NULL = -(2**63)
#: Ids after which a file ends with the document at hand.
FILE_IDS = 1 << 20


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row of small numbers as bits, high bit first; rows (n, BLOCK) give (n, BLOCK * width / 8) bytes."""
    size = 16 if width <= 16 else 32
    bits = np.unpackbits(rows.astype(f">u{size // 8}").view(np.uint8).reshape(len(rows), -1, size // 8), axis=2)
    return np.packbits(bits[:, :, size - width :].reshape(len(rows), -1), axis=1)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    """The small numbers of each row of bytes; a number of 17 bits or less is in the three bytes from its first bit on."""
    if width <= 17:
        at = np.arange(data.shape[1] * 8 // width) * width
        wide = np.zeros((len(data), data.shape[1] + 2), np.uint32)
        wide[:, :-2] = data
        three = (wide[:, :-2] << np.uint32(16)) | (wide[:, 1:-1] << np.uint32(8)) | wide[:, 2:]
        return (np.take(three, at >> 3, axis=1) >> (24 - width - (at & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
    bits = np.unpackbits(data, axis=1).reshape(len(data), -1, width)
    full = np.zeros((*bits.shape[:2], 32), np.uint8)
    full[:, :, 32 - width :] = bits
    return np.packbits(full.reshape(len(data), -1), axis=1).view(">u4").astype(np.uint32)


def encode_file(task: int, number: int, docs: list[int | None], arrays: list[np.ndarray]) -> bytes:
    ids = np.concatenate(arrays).astype(np.uint32) if arrays else np.zeros(0, np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty((blocks, BLOCK), np.uint32)
    flat = full.reshape(-1)
    flat[:n] = ids
    if n:
        flat[n:] = ids[-1]
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    at = BLOCK * PERCENT // 100
    typical = np.partition(rest, at, axis=1)[:, at] if blocks else low
    widths = np.array([int(x).bit_length() for x in typical.tolist()], np.int64)
    over = rest >= (np.int64(1) << widths)[:, None]
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(widths).tolist():
        here = np.flatnonzero(widths == w)
        packed = _pack(rest[here] & np.uint32((1 << w) - 1), w) if w else np.zeros((len(here), 0), np.uint8)
        row, where = np.nonzero(over[here])
        upto = np.searchsorted(row, np.arange(len(here) + 1)).tolist()
        body, size = packed.tobytes(), packed.shape[1]
        places, values = where.astype("<u2").tobytes(), rest[here[row], where].astype("<u4").tobytes()
        for j, (k, least) in enumerate(zip(here.tolist(), low[here].tolist(), strict=True)):
            x, y = upto[j], upto[j + 1]
            bodies[k] = BLOCK_HEAD.pack(least, w, y - x) + body[j * size : (j + 1) * size] + places[2 * x : 2 * y] + values[4 * x : 4 * y]
    starts = np.cumsum([0, *map(len, bodies)]).astype("<u4")
    ids_of = np.array([NULL if d is None else d for d in docs], "<i8")
    return b"".join([HEAD.pack(MAGIC, task, number, len(docs), n, BLOCK), ids_of.tobytes(), np.array([len(a) for a in arrays], "<u4").tobytes(), starts.tobytes(), *bodies])


def decode_file(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """task, number, ids of documents, their lengths, and all token ids."""
    magic, task, number, count, n, size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    docs = np.frombuffer(data, "<i8", count, at)
    at += 8 * count
    lengths = np.frombuffer(data, "<u4", count, at)
    at += 4 * count
    blocks = -(-n // size)
    starts = np.frombuffer(data, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[(at + starts[:-1])[:, None] + np.arange(7)] if blocks else np.zeros((0, 7), np.uint8)
    low = heads[:, :4].copy().view("<u4").reshape(-1)
    widths = heads[:, 4].astype(np.int64)
    extra = heads[:, 5:7].copy().view("<u2").reshape(-1).astype(np.int64)
    out = np.zeros((blocks, size), np.uint32)
    for w in np.unique(widths).tolist():
        if w:
            here = np.flatnonzero(widths == w)
            out[here] = _unpack(raw[(at + starts[here] + 7)[:, None] + np.arange(size * w // 8)], w)
    for k in np.flatnonzero(extra).tolist():
        p = int(at + starts[k] + 7 + size * widths[k] // 8)
        m = int(extra[k])
        out[k, np.frombuffer(data, "<u2", m, p)] = np.frombuffer(data, "<u4", m, p + 2 * m)
    out += low[:, None]
    return task, number, [None if d == NULL else d for d in docs.tolist()], lengths, out.reshape(-1)[:n]


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS, remembered: int = MOST) -> None:
    """Encode every text, append end_id, and write the files in ascending order of doc_id (and of a hash of the text).

    remembered: pieces of text whose ids a Python worker keeps, beside the texts that are sorted.
    """
    spec = load(tokenizer)

    def run(batches):
        e, task, number = encoder(spec, remembered), TaskContext.get().partitionId(), 0
        end = np.full(1, end_id, e.dtype)
        docs, arrays, held = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([encode_file(task, number, docs, arrays)], pa.binary())], ["file"])

        for b in batches:
            for at in range(0, b.num_rows, STEP):
                some = b.slice(at, STEP)
                for doc, ids in zip(some.column(0).to_pylist(), e.encode(some.column(1).to_pylist()), strict=True):
                    docs.append(doc)
                    arrays.append(np.concatenate([ids, end]))
                    held += len(ids) + 1
                    if held >= file_ids:
                        yield row()
                        number, docs, arrays, held = number + 1, [], [], 0
        if docs:
            yield row()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("__key"))
    rows = rows.repartitionByRange("doc_id", "__key").sortWithinPartitions("doc_id", "__key").select("doc_id", "text")
    files = map_batches(rows, run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: task, number, place (in the file), doc_id, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                task, number, docs, lengths, ids = decode_file(data)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([task] * k, pa.int64()), pa.array([number] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array(docs, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["task", "number", "place", "doc_id", "n_tokens", "ids_crc32"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return map_batches(raw, run, "task long, number long, place long, doc_id long, n_tokens long, ids_crc32 long")


def token_table(documents: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files, read them back, and give each document's doc_id, start, n_tokens and ids_crc32.

    start counts the ids of all documents before it: summed over tasks, over a task's files, and inside the file.
    """
    spark = documents.sparkSession
    path = path or new_path(spark, "token-files")
    write_tokens(documents, path, tokenizer, end_id)
    rows = written(read_tokens(spark, path), "token-rows")
    files = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("__n"))
    tasks = files.groupBy("task").agg(F.sum("__n").alias("__all"))
    tasks = tasks.select("task", (F.sum("__all").over(W.orderBy("task")) - F.col("__all")).alias("__task"))
    files = files.join(tasks, "task").select("task", "number", (F.col("__task") + F.sum("__n").over(W.partitionBy("task").orderBy("number")) - F.col("__n")).alias("__file"))
    inside = F.sum("n_tokens").over(W.partitionBy("task", "number").orderBy("place")) - F.col("n_tokens")
    out = rows.withColumn("__inside", inside).join(files, ["task", "number"])
    return out.select("doc_id", (F.col("__file") + F.col("__inside")).alias("start"), "n_tokens", "ids_crc32")
