"""Codes, labels, weights and scaled model inputs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrank.functions.hashing import feature_value, md5_bucket
from sessionrank.operators.ordering import HOT_ROWS, range_running, running_within, window_running

# Label weights of the training target.
ORDERED_WEIGHT = 0.7
CLICKED_WEIGHT = 0.3

# Distinct values up to this many are sent to every executor to be looked up.
SMALL_CODES = 50_000


def dense_codes(frames: Iterable[DataFrame], column: str, out: str = "code", first: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(value, code): distinct non-null values of all frames in order, coded from ``first``.

    Few codes are marked for broadcast: a shuffle join on a column of few values would bring all
    rows of the wide side to as many tasks as there are values.
    """
    values = reduce(DataFrame.union, [f.select(column) for f in frames]).where(F.col(column).isNotNull()).distinct()
    rows = values.count()
    running = window_running if rows <= hot_rows else range_running
    coded = running(values, [], [F.col(column).asc()], {out: F.lit(1).cast("bigint")})
    coded = coded if first == 1 else coded.withColumn(out, F.col(out) + (first - 1))
    return F.broadcast(coded) if rows <= SMALL_CODES else coded


def apply_codes(df: DataFrame, codes: DataFrame, column: str, code: str = "code", out: str | None = None, unseen: int = 0) -> DataFrame:
    """Add the code of a column's value, ``unseen`` for null and unknown values."""
    out = out or f"{column}_{code}"
    table = codes.select(column, F.col(code).alias(out))
    return df.join(table, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(unseen).cast("bigint")))


def group_codes(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, group_id from 0 in key order, group_size)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))
    numbered = running_within(sizes, [], [F.col(key).asc()], {"group_id": F.lit(1).cast("bigint")}, hot_rows)
    return numbered.select(key, (F.col("group_id") - 1).alias("group_id"), "group_size")


def encode_train(train: DataFrame, df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Codes 1..n from training categories; unseen and null become 0."""
    return reduce(lambda d, c: apply_codes(d, dense_codes([train], c, hot_rows=hot_rows), c), columns, df)


def encode_union(train: DataFrame, test: DataFrame, columns: Sequence[str], unknown: str = "unknown", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Label codes from 0 over the values of both frames, null being the word ``unknown``."""
    filled = [f.na.fill(unknown, list(columns)) for f in (train, test)]
    for c in columns:
        codes = dense_codes(filled, c, "label", 0, hot_rows)
        filled = [apply_codes(f, codes, c, "label") for f in filled]
    return filled[0], filled[1]


def any_positive(ordered: str = "ordered", clicked: str = "clicked") -> Column:
    return F.when((F.col(ordered) > 0) | (F.col(clicked) > 0), 1).otherwise(0)


def graded(ordered: str = "ordered", clicked: str = "clicked") -> Column:
    return (F.col(ordered) * 2 + F.col(clicked)).cast("bigint")


def weighted_relevance(w_order: float = ORDERED_WEIGHT, w_click: float = CLICKED_WEIGHT) -> Column:
    """Label mix scaled to 0..1; weights without a positive sum fall back to the defaults."""
    if w_order + w_click <= 0:
        w_order, w_click = ORDERED_WEIGHT, CLICKED_WEIGHT
    total = w_order + w_click
    return (F.col("ordered") * F.lit(w_order) + F.col("clicked") * F.lit(w_click)) / F.lit(total)


def add_sample_weights(df: DataFrame, out: str = "weight", w_order: float = ORDERED_WEIGHT, w_click: float = CLICKED_WEIGHT) -> DataFrame:
    """Positives weigh negatives / positives times their label mix, negatives 1."""
    target = any_positive()
    ratio = df.select(F.sum(1 - target).cast("double") / F.greatest(F.sum(target).cast("double"), F.lit(1.0))).scalar()
    mix = F.col("ordered") * F.lit(w_order) + F.col("clicked") * F.lit(w_click)
    return df.withColumn(out, F.when(target == 1, ratio * mix).otherwise(1.0))


def scale_minmax(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) of the training rows; a constant column becomes 0."""
    stats = train.select(F.struct(*[F.min(c).cast("double").alias(f"{c}_lo") for c in columns], *[F.max(c).cast("double").alias(f"{c}_hi") for c in columns])).scalar()
    with_stats = df.withColumn("_s", stats)
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_s.{c}_lo"), F.col(f"_s.{c}_hi") - F.col(f"_s.{c}_lo")), F.lit(0.0)) for c in columns}
    return with_stats.withColumns(scaled).drop("_s")


def scale_standard(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the training rows; null counts as the mean, spread 0 as 1."""
    stats = train.select(F.struct(*[F.avg(c).alias(f"{c}_mu") for c in columns], *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns])).scalar()
    with_stats = df.withColumn("_s", stats)

    def z(c: str) -> Column:
        mu, sd = F.col(f"_s.{c}_mu"), F.col(f"_s.{c}_sd")
        return (F.coalesce(F.col(c).cast("double"), mu) - mu) / F.when(sd == 0, 1.0).otherwise(sd)

    return with_stats.withColumns({c: z(c) for c in columns}).drop("_s")


def wide_buckets(columns: Sequence[str], buckets: int) -> Column:
    """Bucket numbers of the row's feature=value pairs, one per column: the wide part in sparse form."""
    return F.array(*[md5_bucket(feature_value(c, F.col(c)), buckets) for c in columns])


def model_types(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Booleans to int, numbers to double without nulls; other columns stay."""
    out = []
    for f in df.schema:
        if f.name in keep:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.coalesce(F.col(f.name).cast("int"), F.lit(0)).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
