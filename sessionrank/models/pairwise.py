"""Linear ranking by the squared hinge over all (positive, negative) pairs of a session, without writing pairs.

A pair costs max(0, 1 - (score of the positive - score of the negative))^2. Put every positive at
its score and every negative at its score plus 1: a pair costs the square of how far the negative
lies above the positive. In that order counts, sums and sums of squares of what came before give
loss and gradient of every row, so that a pass costs a sort of each session. Sessions of ordinary
size are packed and sorted in numpy; larger ones are range-partitioned over the order and spread
over many tasks. A pass brings one row of sums from each task together; the optimiser on the
driver sees as many numbers as there are features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.operators.ordering import range_running
from sessionrank.operators.packed import PACKED_ROWS, bounds, flat, pack

MEMORY = 8  # steps the optimiser remembers


def session_sums(x: np.ndarray, positive: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Loss, gradient and number of pairs of sessions whose rows are ``at[i]:at[i + 1]``."""
    n = len(positive)
    if n == 0:
        return 0.0, np.zeros(len(w)), 0.0
    place = x @ w + (~positive)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((place, owner))
    t, pos = place[order], positive[order]

    def upto(values: np.ndarray) -> np.ndarray:
        """Running sums within each session, own row included."""
        total = np.append(0.0, np.cumsum(values))
        return total[1:] - total[at[:-1]][owner]

    def whole(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, len(at) - 1)[owner]

    neg = ~pos
    n_pos, t_pos, q_pos = upto(pos * 1.0), upto(pos * t), upto(pos * t * t)
    n_neg, t_neg = whole(neg * 1.0) - upto(neg * 1.0), whole(neg * t) - upto(neg * t)
    loss = np.sum(neg * (n_pos * t * t - 2 * t * t_pos + q_pos))
    slope = np.where(pos, -2 * (t_neg - n_neg * t), 2 * (n_pos * t - t_pos))
    pairs = np.bincount(owner, pos, len(at) - 1) @ np.bincount(owner, neg, len(at) - 1)
    return float(loss), slope @ x[order], float(pairs)


class Pairs:
    """Loss and gradient over all pairs of a table, as a function of the weights."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str, session: str, item: str, hot_rows: int = PACKED_ROWS):
        self.features, self.session, self.item = list(features), session, item
        rows = train.select(session, item, (F.col(label) > 0).cast("int").alias("_pos"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
        self.cold, self.hot = pack(rows, ["_pos", *features], session, item, hot_rows)

    def _cold(self, w: np.ndarray) -> DataFrame:
        features, schema = self.features, pa.schema([("loss", pa.float64()), ("pairs", pa.float64()), ("slope", pa.list_(pa.float64()))])

        def run(parts):
            loss, pairs, slope = 0.0, 0.0, np.zeros(len(w))
            for part in parts:
                x = np.stack([flat(part.column(c)) for c in features], axis=1)
                a, b, c = session_sums(x, flat(part.column("_pos")) > 0, bounds(part.column("_pos")), w)
                loss, slope, pairs = loss + a, slope + b, pairs + c
            yield pa.RecordBatch.from_pylist([{"loss": loss, "pairs": pairs, "slope": slope.tolist()}], schema=schema)

        return self.cold.select("_pos", *features).mapInArrow(run, "loss double, pairs double, slope array<double>")

    def _hot(self, w: np.ndarray) -> DataFrame:
        score = reduce(lambda a, b: a + b, [F.lit(float(v)) * F.col(c) for v, c in zip(w, self.features)])
        rows = self.hot.withColumn("_t", score + (1 - F.col("_pos")))
        pos, neg = F.col("_pos").cast("double"), (1 - F.col("_pos")).cast("double")
        t = F.col("_t")
        sums = {"_n_pos": pos, "_t_pos": pos * t, "_q_pos": pos * t * t, "_n_neg": neg, "_t_neg": neg * t}
        placed = range_running(rows, [self.session], [t.asc(), F.col("_pos").asc(), F.col(self.item).asc()], sums)
        whole = rows.groupBy(F.col(self.session).alias("_s")).agg(F.sum(neg).alias("_all_neg"), F.sum(neg * t).alias("_all_t"), F.sum(pos).alias("_all_pos"))
        placed = placed.join(whole, F.col(self.session).eqNullSafe(F.col("_s")))
        loss = neg * (F.col("_n_pos") * t * t - 2 * t * F.col("_t_pos") + F.col("_q_pos"))
        slope = F.when(F.col("_pos") == 1, -2 * ((F.col("_all_t") - F.col("_t_neg")) - (F.col("_all_neg") - F.col("_n_neg")) * t)).otherwise(2 * (F.col("_n_pos") * t - F.col("_t_pos")))
        return placed.select(loss.alias("loss"), (neg * F.col("_all_pos")).alias("pairs"), F.array(*[slope * F.col(c) for c in self.features]).alias("slope"))

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray, float]:
        """Loss, gradient and number of pairs at ``w``."""
        parts = [f(w) for f, part in ((self._cold, self.cold), (self._hot, self.hot)) if part is not None]
        rows = reduce(DataFrame.unionByName, parts)
        each = [F.sum(F.get("slope", F.lit(i))).alias(f"s{i}") for i in range(len(w))]
        found = rows.agg(F.sum("loss").alias("loss"), F.sum("pairs").alias("pairs"), *each).first()
        return found["loss"] or 0.0, np.array([found[f"s{i}"] or 0.0 for i in range(len(w))]), found["pairs"] or 0.0


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Weights and the losses on the way, by a limited-memory quasi-Newton search with halved steps."""
    w, (loss, slope), seen, past = start, value(start), [], []
    losses = [loss]
    for _ in range(rounds):
        if np.abs(slope).max(initial=0.0) <= tolerance:
            break
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            kept.append(a)
            way -= a * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(past, reversed(kept)):
            way += (a - (y @ way) / (s @ y)) * s
        step = 1.0
        while True:
            new = w - step * way
            new_loss, new_slope = value(new)
            if new_loss <= loss - 1e-4 * step * (way @ slope) or step < 1e-8:
                break
            step /= 2
        if new_loss >= loss:
            break
        if (new - w) @ (new_slope - slope) > 1e-12:
            past = [*past, (new - w, new_slope - slope)][-MEMORY:]
        w, loss, slope = new, new_loss, new_slope
        losses.append(loss)
    return w, losses


def fit_pairs(train: DataFrame, features: Sequence[str], label: str = "ordered", ridge: float = 1e-3, rounds: int = 30, session: str = "session_id", item: str = "content_id", hot_rows: int = PACKED_ROWS) -> tuple[np.ndarray, list[float]]:
    """Weights of the features and the mean pair losses on the way; sessions of one kind of row have no pairs. No pairs, no weights."""
    pairs = Pairs(train, features, label, session, item, hot_rows)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope, n = pairs(w)
        n = max(n, 1.0)
        return loss / n + ridge / 2 * float(w @ w), slope / n + ridge * w

    return minimise(value, np.zeros(len(features)), rounds)


def linear_model(weights: np.ndarray) -> LinearRegressionModel:
    """The weights as a Spark ML model, whose prediction is the score."""
    context = SparkContext.getOrCreate()
    made = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel("pairwise", _py2java(context, DenseVector(weights)), 0.0)
    return LinearRegressionModel(made).setFeaturesCol("features").setPredictionCol("prediction")
