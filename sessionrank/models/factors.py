"""Second-order factorisation machine for a 0/1 label, fitted on all rows by adaptive moments.

Rows are packed once into blocks of plain numbers, coded where they are few, which stay in memory. A step is one pass: every
task sums the gradient of the log loss over its blocks; the driver adds one short row of sums a task,
as many numbers as there are coefficients. The model is Spark ML's own, with its start, steps and end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import FMClassificationModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.operators.packed import coded, uncoded

INITIAL = 0.01  # deviation of the first factors
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8  # moments of the steps
TOLERANCE = 1e-6


def block_sums(x: np.ndarray, y: np.ndarray, intercept: float, linear: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Gradient of the summed log loss: factors row by row, linear weights, intercept."""
    mixed = x @ factors
    squares = x * x
    raw = intercept + x @ linear + ((mixed * mixed).sum(axis=1) - (squares @ (factors * factors)).sum(axis=1)) / 2
    off = 1 / (1 + np.exp(-np.clip(raw, -700, 700))) - y
    towards = x.T @ (mixed * off[:, None]) - factors * (squares.T @ off)[:, None]
    return np.concatenate([towards.ravel(), x.T @ off, [off.sum()]])


def packed(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row a batch: its features one after another, and its labels; numbers of few values take a byte each."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                *x, y = (coded(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(len(features) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.binary())), pa.array([y], pa.binary())], names=["x", "y"])

    rows = train.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(run, "x array<binary>, y binary")


def gradient(blocks: DataFrame, w: np.ndarray, size: int, k: int) -> tuple[np.ndarray, float]:
    """Mean gradient at the coefficients, and the rows it is over."""
    factors, linear, intercept = w[: size * k].reshape(size, k), w[size * k : -1], float(w[-1])

    def run(batches):
        sums, n = np.zeros(len(w)), 0
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                x, y = np.stack([uncoded(v.as_buffer()) for v in a.values], axis=1), uncoded(b.as_buffer())
                sums += block_sums(x, y, intercept, linear, factors)
                n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(sums, n).tobytes()])], names=["v"])

    # one short row a task
    found = sum(np.frombuffer(v.as_buffer()) for v in blocks.mapInArrow(run, "v binary").toArrow().column("v"))
    return found[:-1] / max(found[-1], 1.0), float(found[-1])


def fit(train: DataFrame, features: Sequence[str], label: str, k: int, rounds: int, step: float, seed: int) -> FMClassificationModel:
    context = SparkContext.getOrCreate()
    pick, size = context._jvm.java.util.Random(seed), len(features)
    w = np.array([pick.nextGaussian() * INITIAL for _ in range(size * k)] + [0.0] * (size + 1))
    blocks = packed(train, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for i in range(1, rounds + 1):
        slope, n = gradient(blocks, w, size, k)
        if not n:
            raise ValueError("there are no rows to learn from")
        m, v = FIRST * m + (1 - FIRST) * slope, SECOND * v + (1 - SECOND) * slope * slope
        new = w - step * (m / (1 - FIRST**i)) / (np.sqrt(v / (1 - SECOND**i)) + TINY)
        near = np.linalg.norm(new - w) < TOLERANCE * max(np.linalg.norm(new), 1.0)
        w = new
        if near:
            break
    blocks.unpersist()
    parts = [float(w[-1]), _py2java(context, DenseVector(w[size * k : -1])), _py2java(context, DenseMatrix(size, k, w[: size * k], True))]
    made = context._jvm.org.apache.spark.ml.classification.FMClassificationModel(f"factors_{seed}", *parts)
    return FMClassificationModel(made).setFeaturesCol("features")
