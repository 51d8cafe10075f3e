"""Regression trees grown level by level over packed rows.

Features become bins once: candidate thresholds are weighted quantiles of a bounded sample, and every
row of the table is binned. Rows are packed in blocks of plain arrays (a byte a feature, key hash,
label, weight, score), so that a pass over the table reads and moves little. A level of a tree is one
pass: tasks sum weight and target per (node, feature, bin), and Spark adds the tasks' sums, so that the
driver sees as many numbers as there are bins of open nodes, or at most ``DRIVER_SUMS`` to add itself. Blocks of losses of sessions, and all blocks of
held-out rows, hold whole sessions, so that a look at these needs no exchange either; a session of more
than ``PACKED_ROWS`` rows is spread over blocks of its own, whose sums are added first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sessionrank.operators.ordering import split_hot
from sessionrank.operators.packed import PACKED_ROWS, coded, uncoded
from sessionrank.operators.ranking import session_aucs
from sessionrank.session import durable

SAMPLE = 50_000  # rows from which thresholds are found; every row is binned
BLOCK = 16_384  # rows of a block, at least, but for the last of a task
CODED = ("y", "w")  # labels and weights have few values
DRIVER_SUMS = 1_000_000  # sums of tasks that the driver adds itself, of 40 bytes each
SHARES = 1_000_000  # sampled shares are counted in millionths
KINDS = {"bins": np.uint8, "y": np.float64, "w": np.float64, "key": np.uint64, "owner": np.int32, "held": np.bool_, "seen": np.float64, "f": np.float64, "path": np.float64}
LEARNED = ("bins", "y", "w", "key", "owner", "held", "f")
WATCHED = ("bins", "seen", "owner", "f", "path")


@dataclass(frozen=True)
class Tree:
    """Nodes as flat arrays, root first; the children of a node are ``left`` and ``left + 1``, a leaf is its own left child."""

    feature: np.ndarray
    cut: np.ndarray  # bins above it go right
    threshold: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    stats: np.ndarray  # weight, sum, sum of squares and rows of every node
    depth: int

    @property
    def value(self) -> np.ndarray:
        return self.stats[:, 1] / np.maximum(self.stats[:, 0], np.finfo(float).tiny)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node at which every row ends."""
        n, flat = bins.shape[1], bins.ravel()
        at, rows = np.zeros(n, np.intp), np.arange(n)
        start, left = self.feature.astype(np.intp) * n, self.left.astype(np.intp)
        for _ in range(self.depth):
            at = left.take(at) + (flat.take(start.take(at) + rows) > self.cut.take(at))
        return at

    def model(self, features: int) -> DecisionTreeRegressionModel:
        """The tree as a Spark ML model."""
        context = SparkContext.getOrCreate()
        tree, impurity = context._jvm.org.apache.spark.ml.tree, context._jvm.org.apache.spark.mllib.tree.impurity

        def node(i: int):
            w, s, q, n = (float(v) for v in self.stats[i])
            sums = context._gateway.new_array(context._jvm.double, 3)
            sums[0], sums[1], sums[2] = w, s, q
            kept = impurity.VarianceCalculator(sums, int(n))
            value, spread = float(self.value[i]), float(spreads(self.stats[i]))
            if self.left[i] == i:
                return tree.LeafNode(value, spread, kept)
            split = tree.ContinuousSplit(int(self.feature[i]), float(self.threshold[i]))
            return tree.InternalNode(value, spread, float(self.gain[i]), node(int(self.left[i])), node(int(self.left[i]) + 1), split, kept)

        made = context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(f"tree_{id(self):x}", node(0), features)
        return DecisionTreeRegressionModel(made)


def spreads(stats: np.ndarray) -> np.ndarray:
    """Weighted variances of targets from (weight, sum, sum of squares, rows)."""
    w = np.maximum(stats[..., 0], np.finfo(float).tiny)
    return np.maximum((stats[..., 2] - stats[..., 1] ** 2 / w) / w, 0.0)


def cuts_of(x: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between values: all if few, else those nearest to equal shares of the weight."""
    values, at = np.unique(x, return_inverse=True)
    values, mass = values[~np.isnan(values)], np.bincount(at, weight)
    middle = (values[:-1] + values[1:]) / 2
    if len(mass) > len(values) > 0:  # missing values lie above all others
        middle = np.append(middle, values[-1])
    if len(middle) < bins:
        return middle
    upto = np.cumsum(mass)[: len(middle)]
    near = np.searchsorted(upto, np.arange(1, bins) * (mass.sum() / bins))
    lower, upper = np.maximum(near - 1, 0), np.minimum(near, len(middle) - 1)
    goal = np.arange(1, bins) * (mass.sum() / bins)
    return middle[np.unique(np.where(np.abs(upto[lower] - goal) <= np.abs(upto[upper] - goal), lower, upper))]


def find_cuts(rows: DataFrame, kept: Column, weight: str | None, bins: int, session: str, item: str) -> list[np.ndarray]:
    """Thresholds of every feature from a sample of the kept rows, chosen by a hash of their keys; all rows if they are few."""
    chosen = rows.where(kept)
    n = chosen.count()
    if n == 0:
        raise ValueError("there are no rows to learn from")
    part = chosen.where(F.pmod(F.xxhash64(session, item), F.lit(SHARES)) < max(1, SAMPLE * SHARES // n)) if n > SAMPLE else chosen
    found = part.select(vector_to_array("features").alias("x"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).toArrow()
    if found.num_rows == 0:
        raise ValueError("the sample for the thresholds is empty")
    x = np.stack(found.column("x").to_pylist()).astype(float)
    w = found.column("w").to_numpy()
    return [cuts_of(x[:, j], w, bins) for j in range(x.shape[1])]


def in_sample(key: np.ndarray, number: int, share: float) -> np.ndarray:
    """The rows that ``xxhash64(session, item, number)`` puts into a share, from the hash of (session, item)."""
    with np.errstate(over="ignore"):
        h = key + np.uint64(0x27D4EB2F165667C5 + 4)
        h ^= np.uint64(number & 0xFFFFFFFF) * np.uint64(0x9E3779B185EBCA87)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        h = h ^ (h >> np.uint64(32))
    return np.mod(h.view(np.int64), SHARES) < int(share * SHARES)


# --- blocks -------------------------------------------------------------------------------------


def array_of(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    held = batch.column(batch.schema.get_field_index(name))[row].as_buffer()
    return uncoded(held) if name in CODED else np.frombuffer(held, KINDS[name])


def blocks_of(parts: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.Table]:
    """Rows in blocks; ``whole`` keeps neighbouring rows of a session together."""
    held = []
    for part in parts:
        held.append(part)
        if sum(p.num_rows for p in held) < BLOCK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        end = table.num_rows
        if whole:
            steps = np.flatnonzero(np.diff(owners(table)))
            end = int(steps[-1]) + 1 if len(steps) else 0
        if end:
            yield table.slice(0, end)
        held = table.slice(end).to_batches() if end < table.num_rows else []
    if sum(p.num_rows for p in held):
        yield pa.Table.from_batches(held).combine_chunks()


def owners(table: pa.Table) -> np.ndarray:
    """A number for the session of every row."""
    names = pc.dictionary_encode(table.combine_chunks().column("s"), null_encoding="encode")
    return (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy().astype(np.int32)


def bins_of(x: pa.Array, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(row, feature) of a list column of values."""
    values = np.asarray(x.flatten()).reshape(len(x), len(cuts))
    return np.stack([np.searchsorted(c, values[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def binned(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """Rows with a byte a feature in place of its values, for an exchange."""
    schema = T.StructType([T.StructField("x", T.BinaryType()) if f.name == "x" else f for f in rows.schema])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("x")
            codes = np.ascontiguousarray(bins_of(batch.column(at), cuts))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(cuts))
            yield batch.set_column(at, "x", pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], pa.py_buffer(codes)]))

    return rows.mapInArrow(run, schema)


def dealt_by_session(rows: DataFrame, cuts: Sequence[np.ndarray], hot_rows: int) -> list[tuple[DataFrame, bool]]:
    """Rows with sessions whole and in item order, then those of sessions too large for a block, spread; each with whether it is whole."""
    cold, hot = split_hot(rows, ["s"], hot_rows)
    parts = [] if cold is None else [(binned(cold, cuts).repartition("s").sortWithinPartitions("s", "i"), True)]
    if hot is not None:
        # one number a session too large for a block: at most one in hot_rows rows
        names = hot.select("s").distinct().coalesce(1).withColumn("_hot", F.monotonically_increasing_id().cast("int"))
        names = durable(names).withColumnRenamed("s", "_s")
        hot = hot.join(F.broadcast(names), F.col("s").eqNullSafe(F.col("_s"))).withColumn("hot", F.col("_hot")).drop("_s", "_hot")
        parts.append((binned(hot, cuts).repartition("hot", F.pmod(F.xxhash64("i"), F.lit(64))).sortWithinPartitions("hot"), False))
    return parts


def block_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.BinaryType()) for c in names], T.StructField("hot", T.IntegerType())])


def block_of(arrays: dict[str, np.ndarray], names: Sequence[str], hot: int) -> list[pa.Array]:
    """The cells of a block; arrays that it does not have are empty."""
    held = [np.ascontiguousarray(arrays.get(c, np.zeros(0, KINDS[c]))) for c in names]
    return [*[pa.array([coded(v) if c in CODED else v.tobytes()], pa.binary()) for c, v in zip(names, held)], pa.array([hot], pa.int32())]


def codes_of(x: pa.Array, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(feature, row) of bins, from values or from the bytes of an exchange."""
    if not pa.types.is_binary(x.type):
        return bins_of(x, cuts).T
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(x), len(cuts)).T


def by_hot(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    number = table.column("hot").to_numpy()
    for hot in np.unique(number):
        yield int(hot), table if (number == hot).all() else table.filter(pa.array(number == hot)).combine_chunks()


def pack_rows(rows: DataFrame, cuts: Sequence[np.ndarray], y: str, weight: str | None, held_out: str | None, label: str, session: str, item: str, whole: bool, hot_rows: int = PACKED_ROWS) -> DataFrame:
    """The rows to learn from as checkpointed blocks, one row each; those of a loss of ``whole`` sessions hold the held-out rows of these, too."""
    held = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    columns = [
        F.xxhash64(session, item).alias("key"), F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        F.col("_f").cast("double").alias("f"), vector_to_array("features").alias("x"), F.lit(-1).alias("hot"),
    ]
    if whole:
        parts = dealt_by_session(rows.select(F.col(session).alias("s"), F.col(item).alias("i"), held.alias("held"), *columns), cuts, hot_rows)
    else:
        parts = [(rows.where(~held).select(*columns), False)]

    def packed(table: pa.Table, hot: int, together: bool) -> pa.RecordBatch:
        arrays = {c: table.column(c).to_numpy() for c in ("y", "w", "key", "f")} | {"bins": codes_of(table.column("x").combine_chunks(), cuts)}
        if whole:
            flags = table.column("held").to_numpy(zero_copy_only=False).astype(bool)
            arrays["held"] = flags if flags.any() else flags[:0]
        if together:
            arrays["owner"] = owners(table)
        return pa.RecordBatch.from_arrays(block_of(arrays, LEARNED, hot), names=[*LEARNED, "hot"])

    def run_of(together: bool):
        return lambda batches: (packed(part, hot, together) for table in blocks_of(batches, together) for hot, part in by_hot(table))

    return durable(reduce(DataFrame.unionByName, [df.mapInArrow(run_of(together), block_schema(LEARNED)) for df, together in parts]))


def pack_watched(rows: DataFrame, cuts: Sequence[np.ndarray], label: str, session: str, item: str, hot_rows: int = PACKED_ROWS) -> DataFrame:
    """Held-out rows as checkpointed blocks with whole sessions in item order; sessions of one kind of label have no AUC and are left out."""
    narrow = rows.select(
        F.col(session).alias("s"), F.col(item).alias("i"), F.col(label).cast("double").alias("seen"),
        F.col("_f").cast("double").alias("f"), vector_to_array("features").alias("x"), F.lit(-1).alias("hot"),
    )
    schema = T.StructType([*block_schema(WATCHED), *[T.StructField(c, T.ArrayType(narrow.schema[c].dataType)) for c in ("s", "i")]])
    spots = [to_arrow_type(narrow.schema[c].dataType) for c in ("s", "i")]

    def packed(table: pa.Table, hot: int, together: bool) -> pa.RecordBatch | None:
        if together:
            owner, kind = owners(table), table.column("seen").to_numpy() > 0
            positive, size = np.bincount(owner, kind), np.bincount(owner)
            table = table.filter(pa.array(((positive > 0) & (positive < size))[owner])).combine_chunks()
            if not table.num_rows:
                return None
        arrays = {c: table.column(c).to_numpy() for c in ("seen", "f")} | {"bins": codes_of(table.column("x").combine_chunks(), cuts)}
        names = [pa.array([], k) for k in spots]
        if together:
            arrays["owner"] = owners(table)
        else:
            names = [table.column(c).combine_chunks() for c in ("s", "i")]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in names]
        return pa.RecordBatch.from_arrays([*block_of(arrays, WATCHED, hot), *lists], names=schema.names)

    def run_of(together: bool):
        def run(batches):
            for table in blocks_of(batches, together):
                yield from (b for b in (packed(part, hot, together) for hot, part in by_hot(table)) if b is not None)

        return run

    parts = dealt_by_session(narrow, cuts, hot_rows)
    return durable(reduce(DataFrame.unionByName, [df.mapInArrow(run_of(together), schema) for df, together in parts]))


def advanced(blocks: DataFrame, trees: Sequence[Tree], step: float) -> DataFrame:
    """Blocks with trees added to their scores; blocks of held-out rows keep the scores after each of the trees."""
    values = [tree.value * step for tree in trees]

    def run(batches):
        for batch in batches:
            made = {"f": [], "path": []}
            for r in range(batch.num_rows):
                f, path = array_of(batch, "f", r), []
                bins = array_of(batch, "bins", r).reshape(-1, len(f))
                for tree, value in zip(trees, values):
                    f = f + value[tree.place(bins)]
                    path.append(f)
                made["f"].append(f.tobytes())
                made["path"].append(np.concatenate(path).tobytes() if "path" in batch.schema.names else None)
            for name in [c for c in made if c in batch.schema.names]:
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(made[name], pa.binary()))
            yield batch

    return blocks.mapInArrow(run, blocks.schema)


def watched_sums(blocks: DataFrame) -> dict[int, tuple[float, int]]:
    """Sum and number of session AUCs after each of the last trees, over the blocks that hold their sessions whole."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                seen, owner = array_of(batch, "seen", r), array_of(batch, "owner", r)
                if not len(owner):
                    continue
                sizes = np.bincount(owner)
                first, labels = np.cumsum(sizes) - sizes, np.nan_to_num(seen)[None]
                for k, score in enumerate(array_of(batch, "path", r).reshape(-1, len(seen))):
                    aucs = session_aucs(score, labels, owner, first, sizes)[0]
                    found.setdefault(k, []).append((float(np.nansum(aucs)), int(np.isfinite(aucs).sum())))
        # a row a tree and task
        columns = [list(found), [math.fsum(s for s, _ in v) for v in found.values()], [sum(n for _, n in v) for v in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.float64(), pa.int64()))], names=["k", "s", "n"])

    rows: dict[int, list] = {}
    for r in blocks.select("seen", "owner", "path").mapInArrow(run, "k int, s double, n bigint").collect():
        rows.setdefault(r["k"], []).append((r["s"], r["n"]))
    return {k: (math.fsum(s for s, _ in v), sum(n for _, n in v)) for k, v in sorted(rows.items())}


def spread_rows(blocks: DataFrame, session: str, item: str, label: str) -> DataFrame:
    """Held-out rows of sessions spread over blocks, with the scores after each of the last trees in ``_path``."""
    kinds = {f.name: f.dataType.elementType for f in blocks.schema if f.name in ("s", "i")}
    schema = T.StructType([T.StructField("s", kinds["s"]), T.StructField("i", kinds["i"]), T.StructField("seen", T.DoubleType()), T.StructField("_path", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                seen = array_of(batch, "seen", r)
                s, i = (batch.column(batch.schema.get_field_index(c))[r].values for c in ("s", "i"))
                path = array_of(batch, "path", r).reshape(-1, len(seen)).T
                at = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * path.shape[1])
                yield pa.RecordBatch.from_arrays([s, i, pa.array(seen), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(path).ravel()))], names=schema.names)

    rows = blocks.where("hot >= 0").select("s", "i", "seen", "path").mapInArrow(run, schema)
    return rows.select(F.col("s").alias(session), F.col("i").alias(item), F.col("seen").alias(label), "_path")


def hot_means(blocks: DataFrame) -> dict[int, float]:
    """The mean open error of every session that is spread over blocks."""

    def run(batches):
        for batch in batches:
            each = [array_of(batch, "y", r) - array_of(batch, "f", r) for r in range(batch.num_rows)]
            hot = batch.column(batch.schema.get_field_index("hot"))
            yield pa.RecordBatch.from_arrays([hot, pa.array([float(e.sum()) for e in each]), pa.array([float(len(e)) for e in each])], names=["hot", "e", "n"])

    sums = blocks.where("hot >= 0").select("hot", "y", "f").mapInArrow(run, "hot int, e double, n double")
    return {r["hot"]: r["m"] for r in sums.groupBy("hot").agg((F.sum("e") / F.sum("n")).alias("m")).collect()}


# --- growing ------------------------------------------------------------------------------------


def level_sums(blocks: DataFrame, loss, tree: Tree, open_: Sequence[int], n_bins: int, features: int, number: int, share: float, means: dict[int, float], tasks: int | None = None) -> np.ndarray:
    """(open node, feature, bin, [weight, sum, sum of squares, rows]) over the rows of this round.

    Sums of few ``tasks`` are added on the driver, which saves a stage; those of many by an exchange.
    """
    slot = np.full(len(tree.left), -1, np.int64)
    slot[list(open_)] = np.arange(len(open_))
    size = len(open_) * n_bins

    def run(batches):
        sums = np.zeros((features, 4, size))
        for batch in batches:
            for r in range(batch.num_rows):
                f, held = array_of(batch, "f", r), array_of(batch, "held", r)
                bins = array_of(batch, "bins", r).reshape(features, len(f))
                owner = array_of(batch, "owner", r)
                hot = batch.column(batch.schema.get_field_index("hot"))[r].as_py()
                target, weight = loss.newton(f, array_of(batch, "y", r), array_of(batch, "w", r), owner, means.get(hot))
                at = slot[tree.place(bins)]
                use = at >= 0
                if len(held):
                    use &= ~held
                if share < 1:
                    use &= in_sample(array_of(batch, "key", r), number, share)
                use = np.flatnonzero(use)
                base, w, t = at[use] * n_bins, weight[use], target[use]
                wt = w * t
                wtt = wt * t
                for j in range(features):
                    k = base + bins[j].take(use)
                    sums[j, 0] += np.bincount(k, w, size)
                    sums[j, 1] += np.bincount(k, wt, size)
                    sums[j, 2] += np.bincount(k, wtt, size)
                    sums[j, 3] += np.bincount(k, minlength=size)
        feature, at = np.nonzero(sums[:, 3])
        found = [pa.array(feature * size + at), *[pa.array(sums[feature, c, at]) for c in range(4)]]
        yield pa.RecordBatch.from_arrays(found, names=["k", "a", "b", "c", "d"])

    columns = ["bins", "f", "y", "w", "key", "owner", "held", "hot"]
    each = blocks.select(*columns).mapInArrow(run, "k bigint, a double, b double, c double, d double")
    if tasks is None or tasks * features * size > DRIVER_SUMS:
        each = each.groupBy("k").agg(*[F.sum(c).alias(c) for c in "abcd"])
    found = each.toArrow()
    at = found.column("k").to_numpy()
    sums = np.stack([np.bincount(at, found.column(c).to_numpy(), features * size) for c in "abcd"], axis=1)
    return sums.reshape(features, len(open_), n_bins, 4).transpose(1, 0, 2, 3)


def best_splits(sums: np.ndarray, cuts: Sequence[np.ndarray], least_rows: int) -> list[tuple[float, int, int, np.ndarray, np.ndarray] | None]:
    """(gain, feature, cut, sums of the left, of the right) of every node, or nothing; equal gains go to the earlier feature and cut."""
    upto = np.cumsum(sums, axis=2)
    left, whole = upto[:, :, :-1], upto[:, :, -1:]
    right = whole - left
    real = np.stack([np.arange(sums.shape[2] - 1) < len(c) for c in cuts])
    fine = real & (left[..., 3] >= least_rows) & (right[..., 3] >= least_rows) & (left[..., 0] > 0) & (right[..., 0] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = whole[..., 0]
        gain = (left[..., 0] / weight) * (right[..., 0] / weight) * (left[..., 1] / left[..., 0] - right[..., 1] / right[..., 0]) ** 2
    gain = np.where(fine, gain, 0.0)
    found = []
    for i, each in enumerate(gain):
        j, k = divmod(int(np.argmax(each)), each.shape[1])
        found.append((float(each[j, k]), j, k, left[i, j, k], right[i, j, k]) if each[j, k] > 0 else None)
    return found


def grow(blocks: DataFrame, loss, cuts: Sequence[np.ndarray], depth: int, least_rows: int, number: int, share: float, spread: bool = True, tasks: int | None = None) -> Tree:
    """One tree on the Newton step of the loss at the scores of the blocks; a pass a level. ``spread`` says that some session may be more than a block, ``tasks`` how many the blocks are read by."""
    n_bins = max(1, *(len(c) for c in cuts)) + 1
    means = hot_means(blocks) if loss.exchanges and spread else {}
    top = np.iinfo(np.uint8).max
    nodes, open_, tree = [[0, top, 0.0, 0, 0.0, np.zeros(4)]], [0], None
    for level in range(max(depth, 1)):
        tree = flat_tree(nodes, level)
        sums = level_sums(blocks, loss, tree, open_, n_bins, len(cuts), number, share, means, tasks)
        if level == 0:
            nodes[0][5] = sums[0, 0].sum(axis=0)
            if nodes[0][5][3] == 0:
                raise ValueError("there are no rows to learn from")
        following = []
        for i, best in zip(open_, best_splits(sums, cuts, least_rows) if depth else []):
            if best is None:
                continue
            gain, j, k, left, right = best
            nodes[i][:5] = [j, k, float(cuts[j][k]), len(nodes), gain]
            for part in (left, right):
                if spreads(part) > np.finfo(float).eps:
                    following.append(len(nodes))
                nodes.append([0, top, 0.0, len(nodes), 0.0, part])
        open_ = following
        if not open_:
            break
    return flat_tree(nodes, depth)


def flat_tree(nodes: Sequence[list], depth: int) -> Tree:
    feature, cut, threshold, left, gain, stats = (list(c) for c in zip(*nodes))
    return Tree(np.array(feature, np.int32), np.array(cut, np.uint8), np.array(threshold, float), np.array(left, np.int32), np.array(gain, float), np.stack(stats), depth)
