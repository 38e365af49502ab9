"""Shared helpers: the shared folder, written tables, checked broadcasts, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of all contracts: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine one of our own where it is unset, on a cluster an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, keeps column pruning."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """df marked for broadcast if its counted rows (a few machine words each) are at most limit; else left to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def parts_for(spark: SparkSession, size: int = 0) -> int:
    """Partitions for a shuffle whose tasks are heavy for their bytes: no fewer than spark.sql.shuffle.partitions, and one for 64 MB of input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 26)


def without(documents: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """documents without the rows whose id and hash of the text are in keys (doc_id, text_key), with all columns.

    The columns travel as one struct, so none can clash with a key's name.
    """
    gone = written(keys.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct(), name)
    gone = small_or_shuffled(gone, gone.count())
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("key")), "left_anti").select("row.*")


def give_back() -> None:
    """Return freed memory to the machine at a task's end: Python workers live on, beside the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch: texts are long, and a batch is in memory several times over.
BATCH = "4m"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own choice, as it may be written.
SPARKS_BATCH = ("64m", "67108864b", "67108864")


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow in batches of BATCH bytes, which the session keeps from then on if it had larger ones."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) in SPARKS_BATCH:  # another choice stands
        conf.set(BATCH_KEY, BATCH)
    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with a per-task state: make() is called once in each task."""

    def run(batches):
        f = make()
        for b in batches:
            yield from f(b)
        give_back()

    return map_batches(df, run, schema)


def crc_fold(spark: SparkSession, df: DataFrame, col: str, modulus: int = 5) -> DataFrame:
    """df with held_out: crc32 of the id as text is divisible by modulus; a null id is held out."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus == 0, F.lit(True)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
