"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of unit length are hashed by several tables of random projections cut into cells. A
query visits the buckets of a table in the order of their estimated success: perturbations of
its cell by one or two steps, the least sum of squared distances to the cell borders first. The
candidates of all tables are merged and ranked by their exact cosine.

The number of probes is calibrated: for a bounded sample of queries the true neighbours are
found over all rows, and the fewest probes that reach the wanted recall on them are taken.
Queries that find too few go on with more probes, round by round. Equal vectors are indexed
once, with as many of their smallest ids as a result can show.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionrank.llm.common import arrow_rows, stored
from sessionrank.llm.vectors import by_length, matrix, nodes, unit, valid

TABLES = 4
FUNCTIONS = 10
CELL = 3.0
PROBES = (16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
NARROW = 512  # probes looked at first in the calibration
WIDER = 8  # times as many probes in the next round of a query that found too few
RECALL = 0.95  # aimed at on the sample; 0.9 is asked for
SAMPLE = 128  # queries of the calibration, at most
BLOCK = 4096  # rows of a bucket in one task
ASKED = 1024  # queries that meet such a block in one task
SEED = 23


@cache
def _table(dim: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, at])
    return rng.normal(size=(dim, FUNCTIONS)), rng.uniform(0, CELL, FUNCTIONS)


def cells(x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell numbers, place inside the cell in 0..CELL) of unit vectors in a table."""
    a, b = _table(x.shape[1], at)
    f = (x @ a + b) / CELL
    h = np.floor(f)
    return h.astype(np.int64), (f - h) * CELL


def bucket(h: np.ndarray) -> np.ndarray:
    """One number per row of cell numbers; 12 bits a cell, cells beyond wrap."""
    key = np.zeros(len(h), np.int64)
    for j in range(h.shape[1]):
        key = (key * 1_000_003) ^ (h[:, j] + 2048)
    return key


def probes(place: np.ndarray, most: int) -> list[list[tuple[int, int]]]:
    """Perturbations [(function, step)] of one query, likeliest first, the unperturbed cell at the start."""
    k = len(place)
    moves = sorted(
        [(place[j] ** 2, j, -1) for j in range(k)] + [((CELL - place[j]) ** 2, j, 1) for j in range(k)]
        + [((place[j] + CELL) ** 2, j, -2) for j in range(k)] + [((2 * CELL - place[j]) ** 2, j, 2) for j in range(k)]
    )
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < most:
        score, chosen = heapq.heappop(heap)
        steps = [moves[i][1:] for i in chosen]
        if len({j for j, _ in steps}) == len(steps):
            out.append(steps)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (score - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + moves[last + 1][0], (*chosen, last + 1)))
    return out


def visited(h: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Buckets of one query in a table, in order of their probes."""
    rows = np.repeat(h[None, :], most, axis=0)
    found = probes(place, most)
    for i, steps in enumerate(found):
        for j, s in steps:
            rows[i, j] += s
    return bucket(rows[: len(found)])


def _best(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """For every query the ``k`` nearest rows of a block, with their exact cosines."""
    q, x = matrix(asked.column("embedding")), matrix(rows.column("embedding"))
    score = unit(q) @ unit(x).T
    take = min(k, len(x))
    top = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(len(x)), score.shape)
    who, which = np.repeat(np.arange(len(q)), take), top.ravel()
    a, b = q[who], x[which]
    exact = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    return pa.table([asked.column("query").take(pa.array(who)), rows.column("node").take(pa.array(which)), pa.array(exact)], names=["query", "node", "score"])


_FOUND = "query bigint, node bigint, score double"
_KEYED = pa.schema([("at", pa.int32()), ("bucket", pa.int64()), ("ident", pa.int64())])


def _bucketed(rows: DataFrame, ident: str, most: int | None) -> DataFrame:
    """at, bucket, ident of rows (ident, dim, embedding): their own buckets, or the ``most`` they visit."""
    kind = pa.int32(), pa.int64(), pa.int64()

    def run(parts):
        for part in parts:
            for _, sub in by_length(part):
                x, ids = unit(matrix(sub.column("embedding"))), sub.column(ident).to_numpy()
                for at in range(TABLES):
                    h, place = cells(x, at)
                    if most is None:
                        yield arrow_rows(_KEYED, [pa.array(np.full(len(x), at), kind[0]), pa.array(bucket(h)), pa.array(ids)])
                        continue
                    for i in range(len(x)):
                        b = np.unique(visited(h[i], place[i], most))
                        yield arrow_rows(_KEYED, [pa.array(np.full(len(b), at), kind[0]), pa.array(b), pa.array(np.full(len(b), ids[i]))])

    return rows.select(ident, "dim", "embedding").mapInArrow(run, "at int, bucket bigint, ident bigint")


def _meet(asked: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best rows of every query, where both have the columns ``keys``; either side of a key is dealt over blocks, and blocks meet blocks."""
    many = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("nr"))
    ask = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(ASKED))).cast("int").alias("nq"))
    blocks = stored(many.join(ask, keys), "near_blocks")
    left = asked.join(blocks, keys).withColumn("qb", F.pmod(F.xxhash64("query"), F.col("nq")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).drop("nr", "nq")
    right = rows.join(blocks, keys).withColumn("rb", F.pmod(F.xxhash64("node"), F.col("nr")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nr", "nq")
    by = [*keys, "qb", "rb"]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _best(a, b, k)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, _FOUND)


def _ranked(found: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query, query_id, rank, vec_id, score: candidates merged, copies as rows of their own, the query's id left out."""
    rows = found.distinct().join(index.select("node", "ids"), "node").join(queries.select("query", "query_id"), "query")
    rows = rows.select("query", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(sample: list, truth: list, recall: float = RECALL) -> int | None:
    """The fewest probes by which the true neighbours (query, vector) of the sample are reached; None if none of PROBES does."""

    def placed(v, at):
        h, place = cells(unit(np.array(v, np.float64)[None, :]), at)
        return h[0], place[0]

    homes = [(q, [int(bucket(placed(v, at)[0][None, :])[0]) for at in range(TABLES)]) for q, v in truth]
    if not homes:
        return PROBES[0]
    for upto in (NARROW, PROBES[-1]):
        order = {(q, at): visited(*placed(v, at), upto) for q, v in sample for at in range(TABLES)}
        hits = [[np.flatnonzero(order[q, at] == home[at]) for at in range(TABLES)] for q, home in homes]
        reached = np.array([min((int(h[0]) for h in hit if len(h)), default=upto) for hit in hits])
        for n in PROBES:
            if n <= upto and (reached < n).mean() >= recall:
                return n
    return None


def search(df: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every row whose id is divisible by ``every``.

    Nearness is the cosine in double precision, among vectors of one length; ties go to the smaller id. Vectors null, zero or
    with null or non-finite components, and rows without an id, take no part. Rows that repeat
    an id are one query for each vector they hold, and no answers to it; equal vectors of other ids are
    answers each. A query with fewer than ``k`` found, of more there are, goes on with ever more probes, up to the
    last of PROBES; only then, and where no number of probes reaches the recall on the sample, every bucket is visited.
    Other columns are not read; no rows give no rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    good = valid(df)
    index = stored(nodes(good, k + 1, "index_groups"), "index")
    asked = good.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).distinct().select("vec_id", F.size("embedding").alias("dim"), "embedding")
    queries = stored(asked.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "dim", "embedding"), "queries")
    rows = index.select("node", "dim", "embedding")

    some = queries.orderBy(F.xxhash64("query_id"), "query").limit(SAMPLE)
    few = stored(some, "query_sample")
    true = _ranked(_meet(few.select("query", "dim", "embedding"), rows, ["dim"], k + 1), few, index, k)
    truth = true.select("query", "vec_id").join(good, "vec_id").select("query", "embedding").collect()  # SAMPLE * k vectors, with their copies of an id
    most = calibrated([(r.query, r.embedding) for r in few.select("query", "embedding").collect()], [(r.query, r.embedding) for r in truth])
    if most is None:  # no number of probes would do
        return _ranked(_meet(queries.select("query", "dim", "embedding"), rows, ["dim"], k + 1), queries, index, k).select("query_id", "rank", "vec_id", "score")

    keys = ["at", "bucket", "dim"]
    homes = _bucketed(rows.repartition(parts), "node", None).withColumnRenamed("ident", "node").join(rows, "node")
    others = index.groupBy("dim").agg(F.sum("n").alias("rows"))

    def probed(some: DataFrame) -> DataFrame:
        visits = _bucketed(some.repartition(parts), "query", most).withColumnRenamed("ident", "query").join(some.select("query", "dim", "embedding"), "query")
        return stored(_ranked(_meet(visits, homes, keys, k + 1), some, index, k), "neighbours")

    def unfilled(some: DataFrame, found: DataFrame) -> DataFrame:
        held = found.groupBy("query").agg(F.count(F.lit(1)).alias("held"))
        short = some.join(held, "query", "left").join(others, "dim").where((F.coalesce("held", F.lit(0)) < k) & (F.coalesce("held", F.lit(0)) < F.col("rows") - 1))
        return stored(short.select("query", "query_id", "dim", "embedding"), "query_rest")

    found = probed(queries)
    short = unfilled(queries, found)
    while not short.isEmpty():
        last = most == PROBES[-1]
        most = min(PROBES[-1], WIDER * most)
        more = stored(_ranked(_meet(short.select("query", "dim", "embedding"), rows, ["dim"], k + 1), short, index, k), "neighbours") if last else probed(short)
        found = found.join(short.select("query"), "query", "left_anti").unionByName(more)
        if last:
            break
        short = unfilled(short, more)
    return found.select("query_id", "rank", "vec_id", "score")
