"""Weighted rendezvous hashing of stable record keys.

Each key draws a number for every shard from a hash of both; the shard with the best draw,
scaled by its weight, holds the record. A draw depends on nothing but key and shard, so one
more shard only wins records for itself and takes none from one old shard to another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionrank.llm.common import stored

PIECE_ROWS = 50_000  # rows of a shard numbered by one task


def draw(key: Column, shard: int, weight: float) -> Column:
    """Exponential draw with the weight as its rate: the smallest of all wins in proportion to the weights."""
    if not weight > 0:
        raise ValueError("weights must be positive")
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards; equal draws go to the smaller number."""
    return F.least(*[F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("s")) for i, w in enumerate(weights)])["s"] if len(weights) > 1 else F.lit(0)


def record_key(ident: Column, text: Column) -> Column:
    """The id as text; rows without an id are known by their text, so that they too spread."""
    return F.coalesce(F.concat(F.lit("i"), ident.cast("string")), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row.

    size is the UTF-8 length plus 1 (null text: 1), slot numbers the rows of a shard from 0
    without gaps, in order of (piece, doc_id, checksum), where a piece is a hash range of keys.
    A large shard is numbered in pieces of bounded size: a window per piece, plus the rows of the pieces
    before it. Null ids take the text as key; equal rows share a shard and have slots of their
    own; no rows give no rows. ``grown_shard`` is the shard among ``grown``, or null.
    """
    text, ident = F.col("text"), F.col("doc_id").cast("bigint")
    body = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(
        ident.alias("doc_id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        record_key(ident, text).alias("key"),
    )
    rows = rows.select("*", rendezvous(F.col("key"), weights).alias("shard"), (rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    placed = stored(rows, "shards")
    pieces = max(1, -(-placed.count() // (PIECE_ROWS * len(weights))))
    # repeats of one key may be many: the checksum and a row's place in the scan part them too
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("key", "text_crc32", F.spark_partition_id()), F.lit(pieces)).cast("int")) if pieces > 1 else placed.withColumn("piece", F.lit(0))
    counts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "piece"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).alias("slot"), "grown_shard")
