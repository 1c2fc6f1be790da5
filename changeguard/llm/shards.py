"""Jump consistent hashing of stable keys to shards, without a ring table. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The multiplier of the 64-bit generator of the jump hash, as two 32-bit halves.
_MULT = 2862933555777941757
_MULT_HI, _MULT_LO = _MULT >> 32, _MULT & 0xFFFFFFFF
_MASK = 0xFFFFFFFF
#: Slots are counted in this many key ranges per shard, so no task holds a shard.
_RANGES_HEX = 3


def _low_product(x: Column, const: int) -> Column:
    """The low 32 bits of ``x * const`` for 32-bit factors; nothing leaves 50 bits, so ANSI mode is content."""
    low, high = x.bitwiseAND(0xFFFF) * const, F.shiftright(x, 16) * const
    return (low + high.bitwiseAND(0xFFFF) * 65536).bitwiseAND(_MASK)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of ``key = key * multiplier + 1`` modulo 2^64 on 32-bit halves."""
    low, high = lo.bitwiseAND(0xFFFF) * _MULT_LO, F.shiftright(lo, 16) * _MULT_LO
    total = low + high.bitwiseAND(0xFFFF) * 65536 + 1
    carry = F.shiftright(total, 32) + F.shiftright(high, 16)
    return (carry + _low_product(hi, _MULT_LO) + _low_product(lo, _MULT_HI)).bitwiseAND(_MASK), total.bitwiseAND(_MASK)


def jump_state(hi: Column, lo: Column, shards: int) -> Column:
    """struct(b, j): the shard among ``shards``, and the first shard count minus one that takes the key away.

    The key leaves shard ``b`` only when shard ``j`` is appended, so
    ``if(j = shards, j, b)`` is its place among ``shards + 1``.
    """
    def step(s, _):
        next_hi, next_lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(next_hi, 1) + 1).cast("double")))
        done = s["j"] >= shards
        return F.struct(
            F.when(done, s["b"]).otherwise(s["j"]).alias("b"), F.when(done, s["j"]).otherwise(jump).alias("j"),
            F.when(done, s["hi"]).otherwise(next_hi).alias("hi"), F.when(done, s["lo"]).otherwise(next_lo).alias("lo"))

    zero = F.lit(0).cast("long")
    start = F.struct((zero - 1).alias("b"), zero.alias("j"), hi.alias("hi"), lo.alias("lo"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def shard_by_key(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Every row with its shard, its slot there and its shard after one more is appended.

    Columns: the key, ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``law`` ("key"), ``shard``,
    ``slot``, ``grown_shard``. Slots count from 0 without gaps within a shard, in the order of the key's digest,
    then crc and size. A NULL key is a key like any other, a NULL text counts no bytes, rows with the same key
    share a shard and have slots of their own; no rows give no rows.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    body = F.coalesce(F.col(text), F.lit(""))
    part = lambda at: F.conv(F.substring("__d", at, 8), 16, 10).cast("long")
    placed = df.select(
        F.col(key), digest.alias("__d"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("__s", jump_state(part(1), part(9), shards)).select(
        key, "__d", "size", "text_crc32", F.col("__s.b").cast("int").alias("shard"),
        F.when(F.col("__s.j") == shards, shards).otherwise(F.col("__s.b")).cast("int").alias("grown_shard"),
        F.substring("__d", 1, _RANGES_HEX).alias("__r"),
    )
    # At most shards * 16^3 rows, whatever the input: broadcast by a proven bound.
    ranges = placed.groupBy("shard", "__r").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("shard", "__r", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("shard", "__r").orderBy("__d", "text_crc32", "size"))
    return placed.withColumn("__n", inside).join(F.broadcast(ranges), ["shard", "__r"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__before") + F.col("__n") - 1).alias("slot"), "grown_shard")
