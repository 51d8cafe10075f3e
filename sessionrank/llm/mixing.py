"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of its documents by a hash, and the blocks are permuted by
another. A source gives whole passes over all of its blocks plus, for the rest of its target,
the first blocks of its permutation (the last one in part), which fixes an exact quota of block
draws. The quotas are split among the output shards by a binary tree: each node deals its block
draws to its two halves as a hypergeometric draw over all sources, so that every shard gets an
equal number of draws with a random mixture and all quotas stay exact. A shard's draws of a source are a
disjoint stretch of the permuted blocks; its rows are shuffled locally by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionrank.llm.common import stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times a source's size that its target may reach
BLOCK_WORDS = 100_000
SHARDS = 16


def words(text: Column) -> Column:
    """Number of words parted by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target of every row (source, source_size) of ``sizes``.

    The sources in order, null last, have the weights in turn and share the total of all sizes
    by weight; a target stops at ``most`` times its source, what is over is shared again by
    weight until none is above. That is one water level: the sources with the least room for
    their weight are full, all others have weight times level.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", turn).withColumn("room", F.lit(float(most)) * F.col("source_size"))
    by_room = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    rows = rows.select(
        "*",
        F.row_number().over(by_room).alias("place"),
        F.sum("source_size").over(whole).cast("double").alias("total"),
        (F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("before"),
        (F.sum("w").over(whole) - F.sum("w").over(upto) + F.col("w")).alias("open"),
    )
    # the first source in this order that is not full sets the level
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("room"), F.struct("place", "level"))).over(whole)["level"]
    rows = rows.withColumn("at", first)
    return rows.select("source", "source_size", F.least(F.col("room"), F.coalesce(F.col("at") * F.col("w"), F.col("room"))).alias("target"))


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) draws: quotas dealt by a binary tree of multivariate hypergeometric draws; columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        # each node has its own seed, so the deal does not depend on the order of the walk
        rng = np.random.default_rng([seed, lo, hi])
        n = int(left.sum())
        part = rng.multivariate_hypergeometric(left, n * (mid - lo) // (hi - lo), method="marginals") if n else left * 0
        deal(part, lo, mid)
        deal(left - part, mid, hi)

    deal(np.asarray(quotas, np.int64), 0, shards)
    return out


def planned(docs: DataFrame, weights: Sequence[float] = WEIGHTS, shards: int = SHARDS, seed: int = 7, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __draws (array of copy, shard, order), one row per row.

    Draws depend on the rows' doc_id, text and source and the seed only, so reruns agree. A source gives
    its target up to half of one row. Empty and null texts have no words and come with their
    blocks. A null source is a source of its own, the last. Repeated rows share a block and are
    drawn as rows of their own. Without any words no row is drawn. Input columns named like the
    new ones are replaced.
    """
    own = ("__size", "__source_size", "__target", "__draws", "__src", "__key", "__block", "__upto")
    text = F.col("text").cast("string")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in own],
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("__src"),
        words(text).alias("__size"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text, F.lit("")), F.lit(seed)).alias("__key"),
    )
    narrow = stored(rows.select("__src", "__size", "__key"), "mix_rows")
    sizes = narrow.groupBy("__src").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    named = sizes.select(F.when(F.col("__src") != "", F.expr("substring(__src, 2)")).alias("source"), "source_size")
    shares = targets(named, weights, MOST).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__src"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    passes = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    shares = shares.withColumn("passes", passes.cast("int"))
    shares = shares.withColumn("rest", F.greatest(F.lit(0.0), F.col("__target") - F.col("passes") * F.col("__source_size")))
    shares = stored(shares.withColumn("blocks", F.ceil(F.col("__source_size") / F.lit(float(block_words))).cast("int") + 1), "mix_sources")

    block = F.pmod(F.xxhash64("__key", F.lit(seed + 1)), F.col("blocks")).cast("int")
    placed = narrow.join(shares.select("__src", "blocks"), "__src").select("__src", block.alias("block"), "__size")
    cut = placed.groupBy("__src", "block").agg(F.sum("__size").alias("words")).join(shares, "__src")
    # every pass permutes the blocks anew; the last pass stops inside the block that reaches the rest
    turns = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("copy"))
    permuted = Window.partitionBy("__src", "copy").orderBy(F.xxhash64("block", "copy", F.lit(seed + 2)), "block")
    turns = turns.select("*", (F.row_number().over(permuted) - 1).alias("rank"), (F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")).alias("start"))
    turns = turns.where((F.col("copy") < F.col("passes")) | (F.col("start") < F.col("rest")))
    turns = turns.withColumn("most", F.when(F.col("copy") < F.col("passes"), F.lit(float("inf"))).otherwise(F.col("rest") - F.col("start")))
    number = Window.partitionBy("__src").orderBy("copy", "rank")
    turns = stored(turns.select("__src", "block", "copy", "most", (F.row_number().over(number) - 1).cast("bigint").alias("draw")), "mix_draws")

    spark = docs.sparkSession
    quotas = turns.groupBy("__src").count().orderBy("__src").collect()  # a number per source
    dealt = split(np.array([q["count"] for q in quotas], np.int64), shards, seed) if quotas else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(dealt, axis=0)
    ranges = [(q["__src"], s, int(ends[s, i] - dealt[s, i]), int(ends[s, i])) for i, q in enumerate(quotas) for s in range(shards) if dealt[s, i]]
    ranges = spark.createDataFrame(ranges, "__src string, shard int, lo bigint, hi bigint")
    draws = turns.join(ranges, "__src").where("draw >= lo and draw < hi")
    draws = draws.groupBy("__src", "block").agg(F.collect_list(F.struct("copy", "shard", "most")).alias("draws"))  # at most MOST + 1

    at = Window.partitionBy("__src", "__block").orderBy(F.xxhash64("__key", F.lit(seed + 3)), "__key").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.join(F.broadcast(shares.select("__src", "__source_size", "__target", "blocks")) if len(quotas) <= 10_000 else shares.select("__src", "__source_size", "__target", "blocks"), "__src")
    inside = inside.withColumn("__block", block).drop("blocks")
    inside = inside.withColumn("__upto", F.coalesce(F.sum("__size").over(at), F.lit(0)) + F.col("__size") / 2)
    joined = inside.join(draws.withColumnRenamed("block", "__block"), ["__src", "__block"], "left")
    taken = F.filter(F.coalesce("draws", F.array().cast("array<struct<copy:int,shard:int,most:double>>")), lambda d: F.col("__upto") <= d["most"])
    order = F.transform(taken, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.xxhash64(F.col("__key"), d["copy"], F.lit(seed + 4)).alias("order")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], "__size", "__source_size", "__target", order.alias("__draws"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, shards: int = SHARDS, seed: int = 7, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The drawn rows with all columns of ``docs`` and __copy, __shard, __order: a shard sorted by __order is shuffled."""
    rows = planned(docs, weights, shards, seed, block_words)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__draws"], F.explode("__draws").alias("__d")).select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "__draws"], F.col("__d.copy").alias("__copy"), F.col("__d.shard").alias("__shard"), F.col("__d.order").alias("__order"))
