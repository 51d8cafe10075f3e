"""Gradient boosting over regression trees, with losses of rows or of whole sessions.

Every round fits one regression tree to the Newton step of the loss at the present scores: the
target is gradient over curvature, the weight the curvature. The training table is binned and packed
once (``trees``); a round adds a tree to the scores of the blocks, which stay in memory, and the
blocks are checkpointed every ``FOLD`` rounds, or every ``every`` if that is more. Lost pieces are
made again from the last checkpoint. The session AUC of all rounds since the last look is
measured in one job on blocks of the held-out rows, which move nothing; after ``patience`` rounds without a better one the loop
stops, and the trees up to the best round are the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.models import trees as packed_trees
from sessionrank.operators.ordering import HOT_ROWS, rank_within
from sessionrank.operators.ranking import CHANCE, auc_of_ranks, order_of
from sessionrank.session import durable

# Rounds of the two heads on all rows, of the local model, and its patience and step.
REFIT_ROUNDS = {"ordered": 486, "clicked": 1421, "any": 486}
MOST_ROUNDS = 5000
PATIENCE = 200
STEP = 0.025183
FLOOR = 1e-6
FOLD = 50  # rounds between checkpoints of the scores


@dataclass(frozen=True)
class Settings:
    rounds: int = MOST_ROUNDS
    patience: int = PATIENCE
    every: int = 10  # rounds between looks at the held-out rows
    depth: int = 6
    step: float = STEP
    subsample: float = 0.8
    bins: int = 64
    least_rows: int = 1  # of a leaf
    seed: int = 42


@dataclass(frozen=True)
class Logistic:
    """Weighted log loss of a 0/1 label."""

    label: str
    weight: str = "weight"
    exchanges: ClassVar[bool] = False

    def newton(self, f: np.ndarray, y: np.ndarray, w: np.ndarray, owner: np.ndarray, mean: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Target and weight of every row at the scores ``f``."""
        p = np.clip(1 / (1 + np.exp(-np.clip(f, -700, 700))), FLOOR, 1 - FLOOR)
        bend = p * (1 - p)
        return (y - p) / bend, w * bend

    def value(self, df: DataFrame) -> float:
        y, f = F.col(self.label), F.col("_f")
        one = F.greatest(f, F.lit(0.0)) - f * y + F.log1p(F.exp(-F.abs(f)))
        return df.agg(F.sum(F.col(self.weight) * one) / F.sum(self.weight)).first()[0]


@dataclass(frozen=True)
class SessionSquares:
    """Squared error of scores and relevance, each minus its session mean: only order and distance within a session count."""

    label: str
    session: str = "session_id"
    exchanges: ClassVar[bool] = True

    def _centred(self, df: DataFrame) -> DataFrame:
        open_ = df.withColumn("_e", F.col(self.label) - F.col("_f"))
        means = open_.groupBy(F.col(self.session).alias("_s")).agg(F.avg("_e").alias("_m"))
        return open_.join(means, F.col(self.session).eqNullSafe(F.col("_s"))).withColumn("_target", F.col("_e") - F.col("_m")).drop("_e", "_m", "_s")

    def newton(self, f: np.ndarray, y: np.ndarray, w: np.ndarray, owner: np.ndarray, mean: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Target and weight of every row; ``owner`` numbers the sessions, ``mean`` is given for a session that is more than this block."""
        e = y - f
        if mean is None:
            n = np.bincount(owner)
            mean = (np.bincount(owner, e) / np.maximum(n, 1))[owner]
        return e - mean, np.ones(len(e))

    def value(self, df: DataFrame) -> float:
        return self._centred(df).agg(F.sqrt(F.avg(F.col("_target") * F.col("_target")))).first()[0]


@dataclass
class Boosted:
    """Trees with their common step; ``history`` has (round, held-out session AUC), best round is the number of trees kept."""

    trees: list
    step: float
    rounds: int
    history: list[tuple[int, float]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    flat: list[packed_trees.Tree] = field(default_factory=list)  # the trees over bins

    def model(self) -> GBTRegressionModel:
        """The trees as one Spark ML model, which can be saved and scores in one pass."""
        context = SparkContext.getOrCreate()
        jvm = context._jvm
        trees = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(self.trees))
        weights = context._gateway.new_array(jvm.double, len(self.trees))
        for i, t in enumerate(self.trees):
            trees[i], weights[i] = t._java_obj, self.step
        made = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"boosted_{uuid.uuid4().hex[:12]}", trees, weights, self.trees[0].numFeatures))
        return made.setFeaturesCol("features").setPredictionCol("prediction")


def round_sums(held: DataFrame, label: str, session: str, item: str, hot_rows: int = HOT_ROWS) -> dict[int, tuple[float, int]]:
    """Sum and number of session AUCs by round, from the scores of several rounds in ``_path``: one job for all of them."""
    rows = held.select(session, item, label, F.posexplode("_path").alias("_round", "_s"))
    ranked = rank_within(rows, ["_round", session], order_of("_s", item), "rank", hot_rows)
    each = auc_of_ranks(ranked, ["_round", session], [label]).groupBy("_round")
    return {r["_round"]: (r["s"] or 0.0, r["n"]) for r in each.agg(F.sum(f"{label}_auc").alias("s"), F.count(f"{label}_auc").alias("n")).collect()}


def round_scores(state: DataFrame, spread: bool, label: str, session: str, item: str) -> dict[int, float]:
    """Session AUC after each of the last trees; none if no session has one."""
    sums = [packed_trees.watched_sums(state)]
    if spread:
        sums.append(round_sums(packed_trees.spread_rows(state, session, item, label), label, session, item))
    found = {}
    for k in sorted(set().union(*sums)):
        total, n = (sum(part[k][i] for part in sums if k in part) for i in range(2))
        if n:
            found[k] = total / n
    return found


@dataclass
class Packed:
    """A training table as blocks with their thresholds, for several runs over the same rows and label."""

    cuts: list[np.ndarray]
    blocks: DataFrame
    watched: DataFrame | None  # held-out rows


def is_spread(blocks: DataFrame) -> bool:
    """Whether some session is more than a block."""
    return not blocks.where("hot >= 0").isEmpty()


def pack(rows: DataFrame, loss, bins: int, held_out: str | None = None, label: str | None = None, session: str = "session_id", item: str = "content_id") -> Packed:
    """The rows as blocks; scores begin at a column ``_f`` if there is one."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    kept = F.lit(True) if held_out is None else ~F.col(held_out)
    weight = getattr(loss, "weight", None)
    cuts = packed_trees.find_cuts(rows, kept, weight, bins, session, item)
    begun, label = rows if "_f" in rows.columns else rows.withColumn("_f", F.lit(0.0)), label or loss.label
    blocks = packed_trees.pack_rows(begun, cuts, loss.label, weight, held_out, label, session, item, loss.exchanges)
    return Packed(cuts, blocks, None if held_out is None else packed_trees.pack_watched(begun.where(held_out), cuts, label, session, item))


def boost(rows: DataFrame, loss, settings: Settings, held_out: str | None = None, label: str | None = None, session: str = "session_id", item: str = "content_id", watch_loss: bool = False, after: Boosted | None = None, packed: Packed | None = None) -> Boosted:
    """Boosted trees on ``rows`` with a vector column ``features``.

    ``held_out`` names a flag of rows that are only looked at: by their session AUC of ``label``
    the loop stops and the best round is chosen. Without it all ``rounds`` are made and kept.
    ``after`` goes on from the trees of an earlier run; ``rounds`` counts these too. ``packed`` holds
    the rows packed before, of the same loss and without ``after``; nothing is packed again then.
    """
    trees, label = list(after.trees) if after else [], label or loss.label
    flat, kept = list(after.flat) if after else [], F.lit(True) if held_out is None else ~F.col(held_out)
    if packed is None:
        begun = after.model().setPredictionCol("_f").transform(rows) if trees else rows
        packed = pack(begun, loss, settings.bins, held_out, label, session, item)
        state, watched = packed.blocks, packed.watched
    else:
        state, watched = (df if df is None or not flat else packed_trees.advanced(df, flat, settings.step) for df in (packed.blocks, packed.watched))
    cuts, chance, unseen, tasks = packed.cuts, None, [], packed.blocks.rdd.getNumPartitions()
    spread, apart = loss.exchanges and is_spread(packed.blocks), watched is not None and is_spread(watched)
    history, losses, best, before = [], [], (len(trees), float("-inf")), None
    for r in range(len(trees) + 1, settings.rounds + 1):
        tree = packed_trees.grow(state, loss, cuts, settings.depth, settings.least_rows, settings.seed + r, settings.subsample, spread, tasks)
        if before is not None:  # the first level has read all of the present blocks
            before.unpersist()
        trees.append(tree.model(len(cuts)))
        flat.append(tree)
        unseen.append(tree)
        before, cached = (state, True) if state.is_cached else (None, False)
        state = packed_trees.advanced(state, [tree], settings.step)
        look, fold = r % settings.every == 0 or r == settings.rounds, r % max(settings.every, FOLD) == 0
        if fold:
            state = durable(state)
            if cached:
                before.unpersist()
                before = None
        else:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if watch_loss:
            losses.append(loss.value(Boosted(trees, settings.step, r).model().setPredictionCol("_f").transform(rows.where(kept))))
        if not look or held_out is None:
            continue
        past, watched = watched, packed_trees.advanced(watched, unseen, settings.step)
        watched = durable(watched) if fold else watched.persist(StorageLevel.MEMORY_AND_DISK)
        seen = round_scores(watched, apart, label, session, item)
        if past.is_cached:
            past.unpersist()
        if not seen and chance is None:
            chance = not rows.where(held_out).isEmpty()
        if chance:
            seen = dict.fromkeys(range(len(unseen)), CHANCE)
        looked = [(r - len(seen) + 1 + i, seen[i]) for i in sorted(seen)]
        history += looked
        best = max([best, *looked], key=lambda h: (h[1], -h[0]))
        unseen = []
        if r - best[0] >= settings.patience:
            break
    for used in (before, state, watched):
        if used is not None and used.is_cached:
            used.unpersist()
    n = best[0] if held_out is not None and best[0] else len(trees)
    return Boosted(trees[:n], settings.step, len(trees), history, losses, flat[:n])
