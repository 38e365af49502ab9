"""From raw documents to packed training sequences, in stages of whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs:

1. toxicity: documents that are predicted toxic go
2. exact_dedup: of texts that are equal without whitespace one stays
3. near_dedup: of texts that link by five-word shingles at a Jaccard similarity of 0.8 the one of smallest id stays
4. mixing: sources are brought to their target weights; a document may go, stay or be repeated
5. packing: token windows, one row per piece of a document

Cases. A null text counts as empty: it is not toxic, one of all empty texts stays, it links with nothing, stays once in the
mix and is the end id alone. Rows of a null or repeated id are told apart by their text; rows alike in id and text stay or
go together. Ties between copies go to the smaller id. Very long texts are worked on whole. Columns that documents do not
have are dropped by the first stage. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dotfield.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from dotfield.llm.common import BATCH as OPERATORS_BATCH
from dotfield.llm.common import BATCH_KEY, SPARKS_BATCH, read, written
from dotfield.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of an Arrow batch here: an executor's memory is shared with what earlier stages have left in it.
BATCH = "2m"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes, if the session has Spark's own or the operators' choice."""
    if spark.conf.get(BATCH_KEY) in (*SPARKS_BATCH, OPERATORS_BATCH):
        spark.conf.set(BATCH_KEY, BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.kept(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The workers' memory is shared with what the stages before have left, and is needed by those of the next run.
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), remembered=100_000, alone=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage learns from labels and the last one needs a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
