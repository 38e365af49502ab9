"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in Spark expressions only.

A stable integer key and the number of shards decide the shard; there is no ring table. When one shard is appended,
the rows that move are exactly those whose next jump lands on the new shard.

Cases. A null key counts as key 0. Rows with one key share a shard. Null or empty texts have no bytes. An empty table
gives an empty table. Further columns of the input are left out of the digest and kept by with_shards(); names that
with_shards() adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the published hash: the multiplier's high and low 32 bits.
MULT_HI, MULT_LO = 0x27BB2EE6, 0x87B0B0FD
LOW32, LOW16 = 0xFFFFFFFF, 0xFFFF
#: Steps made at once; the lazily built rest is needed by hardly any key (a key jumps about ln(shards) times).
FIRST_STEPS = 12


def _halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(LOW32))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULT + 1 modulo 2**64 on 32-bit halves; no product passes 2**63, so ANSI mode holds."""
    a0, a1 = lo.bitwiseAND(F.lit(LOW16)), F.shiftright(lo, 16)
    t0, t1 = a0 * F.lit(MULT_LO), a1 * F.lit(MULT_LO)
    low = t0 + F.shiftleft(t1.bitwiseAND(F.lit(LOW16)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(t1, 16)

    def times(x: Column, m: int) -> Column:  # x * m modulo 2**32
        return (x.bitwiseAND(F.lit(LOW16)) * F.lit(m) + F.shiftleft((F.shiftright(x, 16) * F.lit(m)).bitwiseAND(F.lit(LOW16)), 16)).bitwiseAND(F.lit(LOW32))

    return (carry + times(hi, MULT_LO) + times(lo, MULT_HI)).bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump(key: Column, shards: int) -> Column:
    """struct(b, j): b is the shard among `shards`, j the shard count at which the key moves next (j >= shards)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    hi, lo = _halves(key)
    long = lambda v: F.lit(v).cast("long")

    def step(s: Column, _: Column) -> Column:
        h, low = _advance(s["hi"], s["lo"])
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1).cast("double")))
        return F.when(s["j"] < shards, F.struct(h.alias("hi"), low.alias("lo"), s["j"].alias("b"), to.cast("long").alias("j"))).otherwise(s)

    s = F.struct(hi.alias("hi"), lo.alias("lo"), long(-1).alias("b"), long(0).alias("j"))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(min(FIRST_STEPS, shards))), s, step)
    if shards > FIRST_STEPS:
        rest = F.when(s["j"] < shards, F.sequence(F.lit(1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
        s = F.aggregate(rest, s, step)
    return s


def with_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with shard, and grown_shard: the shard when one more is appended."""
    kept = [c for c in df.columns if c not in ("shard", "grown_shard")]
    moved = df.select(*[F.col(f"`{c}`") for c in kept], jump(F.col(f"`{key}`"), shards).alias("__jump"))
    return moved.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__jump.b").cast("int").alias("shard"),
        F.when(F.col("__jump.j") == shards, F.lit(shards)).otherwise(F.col("__jump.b")).cast("int").alias("grown_shard"),
    )


def with_slots(df: DataFrame, order: list[str], block: Column, block_rows: int = 100_000) -> DataFrame:
    """df with slot: gapless from 0 in each shard.

    A shard is cut into blocks of about block_rows rows; block is an integer expression that spreads rows evenly. Rows
    are numbered in their block, and the blocks' counts, summed in order, are added; so no task holds a whole shard.
    """
    rows = df.count()
    blocks = max(1, -(-rows // block_rows))
    cut = df.withColumn("__block", F.pmod(block, F.lit(blocks)))
    before = cut.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("shard", "__block", (F.sum("__n").over(W.partitionBy("shard").orderBy("__block")) - F.col("__n")).alias("__before"))
    here = F.row_number().over(W.partitionBy("shard", "__block").orderBy(*order))
    numbered = cut.withColumn("__here", here).join(before, ["shard", "__block"])
    return numbered.select(*df.columns, (F.col("__before") + F.col("__here") - 1).cast("long").alias("slot"))


def shard_digest(documents: DataFrame, shards: int = 24, block_rows: int = 100_000) -> DataFrame:
    """One row per document: size, crc32 of the text, law, shard, slot in the shard, and the shard after growth."""
    slim = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    placed = with_shards(slim, "doc_id", shards).withColumn("law", F.lit("key"))
    hi, _ = _advance(*_halves(F.col("doc_id")))
    out = with_slots(placed, ["doc_id", "size", "text_crc32"], hi + F.coalesce(F.col("text_crc32"), F.lit(0)), block_rows)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
