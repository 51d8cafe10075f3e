"""Embedding near-duplicates by collision counting on sorted projections.

Every vector is projected on many random lines. On each line the vectors of a block are sorted,
and a query's window, centred on its own projection, is the run of ranks that two binary searches
find. It holds a pair at the threshold cosine with known probability. The windows in which a
pair meets are counted, and pairs that reach a count, set so that a pair at the threshold
reaches it with the wanted recall, are verified by their cosine in double precision.

Counting needs candidates: lists of vectors that lie on the same sides of some further lines
cut at zero. Their number of lines and lists is the cheapest that keeps the recall for the
number of vectors at hand, one list of all being the plainest. A list is worked on in blocks
of bounded bytes, every block against every other, so that its size, however many near copies
it holds, bounds no task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.llm.common import arrow_rows, components, small_or_shuffled, stored
from sessionrank.llm.vectors import binomial_least, by_length, matrix, nodes, normal_below, unit, valid

COSINE = 0.9
LINES = 24
WINDOW = 1.645  # half width of a window in standard deviations of the difference of a pair at the threshold
RECALL = 0.995  # of the count, and of the lists
BLOCK_BYTES = 8 << 20  # of a block's vectors in double precision
LEAST, MOST = 1024, 16_384  # rows of a block, whatever the length of its vectors; ranks fit 16 bits
ROWS = 128  # queries of a block that are counted against another block at once
SEED = 11
PAIR_S, COPY_S = 4e-9, 2e-5  # cost of counting a pair, and of a vector in one more list with its way over the network


def lists_for(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(sides, lists) of least cost for n vectors: a pair at the threshold shares all sides of some list with the wanted recall."""
    same = 1 - math.acos(cosine) / math.pi
    best = None
    for sides in range(0, 31):
        p = same**sides
        count = 1 if sides == 0 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        cost = count * (n * n / 2.0 / 2**sides * PAIR_S + n * COPY_S)
        if best is None or cost < best[0]:
            best = (cost, sides, count)
    return best[1], best[2]


def _lines(dim: int, count: int) -> np.ndarray:
    """``count`` random lines as columns; fewer are the first of more."""
    return np.ascontiguousarray(np.random.default_rng([SEED, dim]).normal(size=(count, dim)).T)


def sides_of(x: np.ndarray, sides: int, lists: int) -> np.ndarray:
    """The code of sides of unit vectors in each of the first ``lists`` lists."""
    bits = (x @ _lines(x.shape[1], LINES + sides * lists)[:, LINES:] > 0).reshape(len(x), lists, sides).astype(np.int64)
    return (bits << np.arange(sides)).sum(axis=2)


_PLACE = pa.schema([("node", pa.int64()), ("list", pa.int32()), ("code", pa.int64())])


def _places(rows: DataFrame, sides: int, lists: int) -> DataFrame:
    """node, list, code: the place of every vector in every list."""

    def place(parts):
        for part in parts:
            for _, sub in by_length(part):
                node, code = sub.column("node").to_numpy(), sides_of(unit(matrix(sub.column("embedding"))), sides, lists)
                yield arrow_rows(_PLACE, [np.repeat(node, lists), np.tile(np.arange(lists, dtype=np.int32), len(node)), code.ravel()])

    return rows.select("node", "dim", "embedding").mapInArrow(place, "node bigint, list int, code bigint")


class Block:
    """Vectors of one length with their projections and, for lists after the first, their sides in the lists before ``at``."""

    def __init__(self, rows: pa.Table, sides: int, at: int):
        self.node, self.count = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        self.vector = unit(matrix(rows.column("embedding")))
        dim = self.vector.shape[1]
        self.line = self.vector @ _lines(dim, LINES)
        self.side = sides_of(self.vector, sides, at)


def _lines_sorted(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(projections of each line in ascending order, rank of each vector on each line)."""
    order = np.argsort(line, axis=0, kind="stable")
    rank = np.empty(line.shape[::-1], np.uint16)
    for p in range(line.shape[1]):
        rank[p, order[:, p]] = np.arange(len(line), dtype=np.uint16)
    return np.ascontiguousarray(np.take_along_axis(line, order, axis=0).T), rank


def close_pairs(a: Block, b: Block, cosine: float, same: bool):
    """Verified pairs (rows of a, rows of b) of two blocks of a list that no earlier list holds; of one block each pair once.

    The rows of a are the queries: on each line, their windows among the sorted rows of b.
    """
    half = WINDOW * math.sqrt(2 - 2 * cosine)
    least = binomial_least(LINES, 2 * normal_below(WINDOW) - 1, RECALL)
    ordered, rank = _lines_sorted(b.line)
    low = np.empty((LINES, len(a.node)), np.uint16)
    span = np.empty_like(low)
    for p in range(LINES):
        first, stop = np.searchsorted(ordered[p], a.line[:, p] - half, "left"), np.searchsorted(ordered[p], a.line[:, p] + half, "right")
        low[p], span[p] = first, stop - first
    for lo in range(0, len(a.node), ROWS):
        begin = lo if same else 0  # earlier rows of the same block have met these
        some = slice(lo, lo + ROWS)
        counts = np.zeros((len(a.node[some]), len(b.node) - begin), np.uint8)
        place, hit = np.empty(counts.shape, np.uint16), np.empty(counts.shape, bool)
        for p in range(LINES):
            # a rank before the window wraps round to a number beyond its span
            np.subtract(rank[p, None, begin:], low[p, some, None], out=place)
            np.less(place, span[p, some, None], out=hit)
            np.add(counts, hit.view(np.uint8), out=counts)
        r, c = np.nonzero(counts >= least)
        r, c = r + lo, c + begin
        if same:
            r, c = r[c > r], c[c > r]
        for i in range(0, len(r), 200_000):
            x, y = r[i : i + 200_000], c[i : i + 200_000]
            ok = np.einsum("ij,ij->i", a.vector[x], b.vector[y]) >= cosine
            ok &= ~(a.side[x] == b.side[y]).any(axis=1)
            yield x[ok], y[ok]


def _count(a: Block, b: Block, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row of a and b, nodes and the group heads they join) of two blocks."""
    n = len(a.node)
    node = a.node if same else np.concatenate([a.node, b.node])
    links, head = np.zeros(len(node), np.int64), np.arange(len(node))
    for x, y in close_pairs(a, b, cosine, same):
        shift = 0 if same else n
        np.add.at(links, x, b.count[y])
        np.add.at(links, y + shift, a.count[x])
        edge = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
        for i, j in zip(edge, [*edge[1:], len(x)]):
            groups = np.unique(head[np.append(y[i:j] + shift, x[i])])
            if len(groups) > 1:
                head[np.isin(head, groups[1:])] = groups[0]
    return links, node, node[head]


def near_duplicates(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``df`` (vec_id, embedding).

    Cosines are taken in double precision between vectors of one length. Vectors that are null, zero
    or hold null or non-finite components link with nothing and are their own component. A row without
    an id links with nothing, has a null component and is not kept. Equal vectors are one node and count as links
    of each other; rows that repeat an id count as rows. Other columns are not read; no rows give no rows.
    """
    spark = df.sparkSession
    good = valid(df)
    distinct = stored(nodes(good, 1, "near_groups"), "near_nodes")
    sides, lists = lists_for(max(1, distinct.count()), cosine)
    # the numbers of a list and code, its blocks, and the vectors with the block they fall in
    places = _places(distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), sides, lists)
    rows = distinct.select("node", "n", "dim", "embedding")
    rows = rows.join(stored(places, "near_places"), "node") if sides else rows.withColumn("list", F.lit(0)).withColumn("code", F.lit(0).cast("bigint"))
    bound = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("dim"))))
    sizes = rows.groupBy("list", "dim", "code").agg(F.count(F.lit(1)).alias("k"))
    sizes = stored(sizes.select("list", "dim", "code", F.ceil(F.col("k") / bound).cast("int").alias("blocks")), "near_sizes")
    codes, groups = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0))).first()
    placed = rows.join(small_or_shuffled(sizes, codes), ["list", "dim", "code"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets every block of its list once: the pair of their numbers, in order, is the group
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("head", pa.int64())])

    def compare(key, table):
        at, low, high = key[0].as_py(), key[3].as_py(), key[4].as_py()
        one, two = (table.filter(pc.equal(table.column("block"), b)) for b in (low, high))
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        a = Block(one, sides, at)
        links, node, head = _count(a, a if low == high else Block(two, sides, at), cosine, low == high)
        some = links > 0
        return pa.table([pa.array(node[some]), pa.array(links[some]), pa.array(head[some])], schema=schema)

    keys = ["list", "dim", "code", "low", "high"]
    spread = met.repartition(int(min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups))), *keys)
    found = stored(spread.groupBy(*keys).applyInArrow(compare, "node bigint, links bigint, head bigint"), "near_found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")), "near_components")
    named = distinct.select("node", "n", F.col("ids")[0].alias("first"), "embedding").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    ident = df.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    # rows that take no part: all rows less the valid ones, counted by id
    rest = ident.groupBy("vec_id").agg(F.count(F.lit(1)).alias("all")).join(good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("some")), "vec_id", "left")
    rest = rest.withColumn("left", (F.col("all") - F.coalesce("some", F.lit(0))).cast("int")).where(F.col("left") > 0)
    rest = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("left")))).drop("col")
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
