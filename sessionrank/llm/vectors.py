"""Shared parts of the vector operators: valid rows, equal vectors, packed blocks, normal quantiles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrank.llm.common import stored


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that have an id and a vector of finite numbers that is not all zero."""
    kind = df.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def nodes(rows: DataFrame, ids: int, name: str) -> DataFrame:
    """One row per distinct vector: node (a number of its own), dim, n (rows), ids (the smallest ``ids`` of their ids, ascending), embedding.

    Copies meet in an aggregation with partial sums; of the ids only the smallest are kept, before and after the exchange.
    """
    if ids == 1:
        one = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"), F.array(F.min("vec_id")).alias("ids"))
        return stored(one, name).select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "n", "ids", "embedding")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    small = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= ids).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    count = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"))
    both = stored(count.join(small, "embedding"), name)
    return both.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "n", "ids", "embedding")


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch that all have one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def by_length(part: pa.RecordBatch):
    """(length, rows) of the lengths in a batch."""
    dims = part.column("dim").to_numpy()
    for d in np.unique(dims):
        yield int(d), part.filter(pa.array(dims == d))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def normal_below(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def binomial_least(m: int, p: float, recall: float) -> int:
    """The largest count that a binomial of m and p reaches with at least the wanted probability."""
    tail, k = 0.0, m
    while k > 0:
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
        k -= 1
    return 0
