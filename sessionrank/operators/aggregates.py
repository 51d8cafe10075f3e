"""Grouped statistics. All are algebraic or two-step, so map-side aggregation absorbs hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.functions.dates import floor_hour

# Aggregate names used in derived column names.
FUNCTIONS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct}


def by_spec(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[str]], prefix: str, digits: int | None = None) -> DataFrame:
    """Columns ``prefix_column_function`` for every column and function of a spec."""
    aggs = []
    for column, functions in spec.items():
        for fn in functions:
            value = FUNCTIONS[fn](column)
            if digits is not None and fn in ("sum", "mean"):
                value = F.round(value.cast("double"), digits)
            aggs.append(value.alias(f"{prefix}_{column}_{fn}"))
    return df.groupBy(*keys).agg(*aggs)


def join_on_key(base: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """Left joins on one key, one after another; they share the key's partitioning."""
    return reduce(lambda left, right: left.join(right, key, "left"), parts, base)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest row per key by ``order`` (largest wins), as an aggregate instead of a sort."""
    rest = [c for c in columns if c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in [*order, *rest]])


def mode_per_key(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Most frequent value per key, smallest on ties: count the pairs, then keep the best."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_best")
    return counted.groupBy(*keys).agg(best).select(*keys, F.col("_best.v").alias(out))


def clipped_ctr(df: DataFrame, keys: Sequence[str], impression: str, click: str, out: str, floor: float = 1e-8) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(click) / F.greatest(F.sum(impression).cast("double"), F.lit(floor))).alias(out))


def diversity(df: DataFrame, keys: Sequence[str], of: Sequence[str]) -> DataFrame:
    """Row count and distinct values per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in of])


def class_balance(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per label: positives, negatives and the positive class weight."""
    n = F.count(F.lit(1))
    cells = [
        F.struct(F.lit(c).alias("label"), F.sum(c).cast("bigint").alias("pos"), (n - F.sum(c)).cast("bigint").alias("neg")) for c in labels
    ]
    one, pos, neg = F.lit(1.0), F.col("pos").cast("double"), F.col("neg").cast("double")
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c")).withColumns({
        "scale_pos_weight": F.greatest(neg, one) / F.greatest(pos, one),
        "pos_weight_plus_one": neg / (pos + one),
    })


def time_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day, hour, hour of day and weekday in one pass: (grain, bucket, n).

    The rows are counted per hour first; the four views come from that small table.
    """
    per_hour = df.groupBy(floor_hour(ts).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    text = F.col("h").cast("string")
    views = F.array(
        F.struct(F.lit("day").alias("grain"), F.substring(text, 1, 10).alias("bucket")),
        F.struct(F.lit("hour").alias("grain"), F.substring(text, 1, 13).alias("bucket")),
        F.struct(F.lit("hour_of_day").alias("grain"), F.hour("h").cast("string").alias("bucket")),
        F.struct(F.lit("weekday").alias("grain"), F.weekday("h").cast("string").alias("bucket")),
    )
    return per_hour.select("n", F.inline(views)).groupBy("grain", "bucket").agg(F.sum("n").cast("bigint").alias("n"))
