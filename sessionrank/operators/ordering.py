"""Order-dependent operators that stay exact when one group holds most of the rows.

A window sorts each group in one task. That is right for groups of known size, so
every operator here first counts the groups: those below ``hot_rows`` take the
window, those above are range-partitioned over the whole order, so that one group
spreads over many tasks, and are stitched together with per-range totals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrank.session import durable

HOT_ROWS = 1_000_000
SMALL_ROWS = 200_000
FANOUT = 64


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of groups a window can hold, rows of the larger groups); absent parts are None."""
    if not keys:
        return (df, None) if df.count() <= hot_rows else (None, df)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    if large.isEmpty():
        return df, None
    hot = durable(large)
    match = [df[k].eqNullSafe(hot[k]) for k in keys]
    return df.join(hot, match, "left_anti"), df.join(hot, match, "left_semi")


def window_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Running sums inside each group with one sort per group."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(c).over(frame).alias(name) for name, c in sums.items()])


def range_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Running sums over a range partitioning of (keys, order); no task holds a whole group.

    The placed rows are checkpointed because range bounds are sampled: totals and rows
    must see the same bounds. ``order`` must make rows of a group distinct.
    """
    names = list(sums)
    by = [F.col(k).asc() for k in keys] + list(order)
    placed = durable(
        df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
        .repartitionByRange(*by)
        .withColumn("_range", F.spark_partition_id())
    )
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, range): at most as many rows per group as there are partitions
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
    )
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_l_{n}") for n in names])
    match = (local["_range"] == offsets["_r"])
    for k in keys:
        match = match & local[k].eqNullSafe(offsets[f"_k_{k}"])
    return local.join(offsets, match, "inner").select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]
    )


def running_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running sums in each group, current row included; an empty ``keys`` is one global group."""
    cold, hot = split_hot(df, keys, hot_rows)
    parts = []
    if cold is not None:
        parts.append(window_running(cold, keys, order, sums))
    if hot is not None:
        parts.append(range_running(hot, keys, order, sums))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based position of each row in its group; ``order`` must make rows distinct."""
    return running_within(df, keys, order, {out: F.lit(1).cast("bigint")}, hot_rows)


def literal(value, dtype: T.DataType) -> Column:
    """A literal of the given type; times go through text so no time zone is applied."""
    if isinstance(value, (dt.datetime, dt.date)):
        return F.lit(str(value)).cast(dtype)
    return F.lit(value).cast(dtype)


def key_literal(df: DataFrame, cols: Sequence[str], values: Sequence) -> Column:
    return F.struct(*[literal(v, df.schema[c].dataType).alias(c) for c, v in zip(cols, values)])


def _slice_of(key: Column, pivots: list[Column]) -> Column:
    """Slice number by a balanced comparison tree: 2i+1 equals pivot i, 2i lies before it."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        return F.when(key == pivots[mid], 2 * mid + 1).when(key < pivots[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(pivots))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The frame held on the executors (memory, then disk) while a search passes over it again and again.

    Lost pieces are computed anew from the lineage. Give it narrow frames.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def key_at(df: DataFrame, cols: Sequence[str], position: int, rows: int | None = None, small_rows: int = SMALL_ROWS) -> tuple:
    """The order key at a 0-based position of the ascending order of ``cols`` (no nulls).

    Distributed selection without a sort: sampled pivots cut the rows into slices, the
    slices are counted in one aggregation, and the search goes on inside the slice that
    holds the position, until it is small. Pivots only steer the search; the result is exact.
    """
    part = df.select(*cols)
    key = F.struct(*cols)
    n = part.count() if rows is None else rows
    if not 0 <= position < n:
        raise ValueError(f"position {position} outside 0..{n - 1}")
    while n > small_rows:
        sample = part.sample(fraction=min(1.0, FANOUT / n)).distinct().orderBy(*cols).collect()
        if not sample:
            if part.isEmpty():
                raise ValueError("order columns must not be null")
            continue
        pivots = [key_literal(df, cols, row) for row in sample]
        counts = dict(part.groupBy(_slice_of(key, pivots).alias("slice")).count().collect())
        before, chosen = 0, 0
        for chosen in range(2 * len(pivots) + 1):
            size = counts.get(chosen, 0)
            if position < before + size:
                break
            before += size
        if chosen % 2:
            return tuple(sample[chosen // 2])
        i = chosen // 2
        first = F.col(cols[0])
        if i > 0:
            part = part.where(first >= literal(sample[i - 1][0], df.schema[cols[0]].dataType)).where(key > pivots[i - 1])
        if i < len(pivots):
            part = part.where(first <= literal(sample[i][0], df.schema[cols[0]].dataType)).where(key < pivots[i])
        position -= before
        n = counts[chosen]
    return tuple(part.orderBy(*cols).offset(position).limit(1).collect()[0])


def weighted_values_at(df: DataFrame, column: str, weight: str, positions: Sequence[int], small_rows: int = SMALL_ROWS) -> list:
    """The values at some 0-based positions of the ascending order in which every row stands ``weight`` times.

    All positions are sought in the same passes. A pass draws pivots from the rows that may
    still hold one, adds up the weights of the slices between them, and keeps the slices
    that hold a position; when few distinct values are left they are added up one by one.
    Pivots only steer the search; the result is exact. Values must not be null or NaN.
    """
    rows = df.select(F.col(column).alias("v"), F.col(weight).cast("bigint").alias("w")).where("w > 0")
    kind = df.schema[column].dataType
    value = F.col("v")
    # every open interval: (low, high) exclusive, None without an end; the weight before it; its positions
    open_: list[tuple] = [(None, None, 0, sorted(set(positions)))] if positions else []
    found: dict[int, object] = {}

    def inside(low, high) -> Column:
        bound = F.lit(True)
        if low is not None:
            bound = bound & (value > literal(low, kind))
        return bound if high is None else bound & (value < literal(high, kind))

    while open_:
        part = rows.where(reduce(lambda a, b: a | b, [inside(low, high) for low, high, *_ in open_]))
        n = part.count()
        if n <= small_rows:
            listed = sorted((r["v"], r["w"]) for r in part.groupBy("v").agg(F.sum("w").alias("w")).collect())
            for low, high, before, wanted in open_:
                for v, w in listed:
                    if (low is None or v > low) and (high is None or v < high):
                        found.update({p: v for p in wanted if before <= p < before + w})
                        before += w
            break
        pivots = sorted({r["v"] for r in part.sample(fraction=min(1.0, FANOUT / n)).select("v").distinct().collect()})
        if not pivots:
            continue
        slot = _slice_of(value, [literal(v, kind) for v in pivots])
        nth = reduce(lambda c, i: c.when(inside(*open_[i][:2]), i), range(1, len(open_)), F.when(inside(*open_[0][:2]), 0))
        sums = {(r["i"], r["s"]): r["w"] for r in part.groupBy(nth.alias("i"), slot.alias("s")).agg(F.sum("w").alias("w")).collect()}
        narrowed = []
        for i, (low, high, before, wanted) in enumerate(open_):
            for s in range(2 * len(pivots) + 1):
                w = sums.get((i, s), 0)
                here = [p for p in wanted if before <= p < before + w]
                if here and s % 2:
                    found.update(dict.fromkeys(here, pivots[s // 2]))
                elif here:
                    left, right = pivots[s // 2 - 1] if s else None, pivots[s // 2] if s // 2 < len(pivots) else None
                    narrowed.append((max((x for x in (low, left) if x is not None), default=None), min((x for x in (high, right) if x is not None), default=None), before, here))
                before += w
        open_ = narrowed
    if set(positions) - set(found):
        raise ValueError("position beyond the last row")
    return [found[p] for p in positions]


def weighted_quantile(df: DataFrame, column: str, weight: str, q: float, small_rows: int = SMALL_ROWS) -> float | None:
    """Exact quantile of values that stand ``weight`` times each, with linear interpolation between the two nearest."""
    numbers = df.select(F.col(column).cast("double").alias("v"), F.col(weight).cast("bigint").alias("w")).where("v is not null and not isnan(v)")
    with kept(numbers) as values:
        n = values.agg(F.sum("w")).first()[0] or 0
        if n == 0:
            return None
        where = q * (n - 1)
        low = int(where)
        a, b = weighted_values_at(values, "v", "w", [low, min(low + 1, n - 1)], small_rows)
        return a + (b - a) * (where - low)


def exact_quantile(df: DataFrame, column: str, q: float, small_rows: int = SMALL_ROWS) -> float | None:
    """Exact quantile with linear interpolation between the two nearest values."""
    return weighted_quantile(df.withColumn("_one", F.lit(1)), column, "_one", q, small_rows)
