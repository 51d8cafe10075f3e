"""Size-aware heavy-light set join of documents on word shingles.

Two sets link when their Jaccard similarity is 0.75 or more. All sets are read in one order,
the rare shingles first, so that linked sets share shingles in their prefixes. Small sets
enumerate fixed-size subsets (pairs) of a prefix that is one longer, of which linked sets share
one; large sets are found by scanning the inverted lists of single prefix shingles. The size
where this changes is chosen by cost, from the mean length of the lists that a posting meets.

Members of a list are first compared with a few hubs of the list, which joins most groups of near
copies and leaves nothing to compare in a short list. Rounds follow in which members outside the
largest component of a longer list are compared with ever more leaders of it; then every two members
that no chain of links joins yet are compared. So no group is compared in all pairs, and no link that
would join two groups is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionrank.llm.common import BROADCAST_ROWS, arrow_rows, components, fixed_columns, mix, raw_bytes, shingle_hashes, small_or_shuffled, sliced, stored, word_hashes

WIDTH = 5
CELL_BITS = 22
CELLS = 1 << CELL_BITS  # of the frequency sketch; a fixed size whatever the corpus
CHUNK = 1 << 16  # cells in one row of it
HUBS = 3  # members of a list that all its members are compared with first
LIST_ROWS = 1_000_000  # postings in one shuffled group, about
HOT = 200_000  # documents of a shingle from which its list is dealt over several parts
LEADERS = (4, 16, 64)  # members of a list that its open members meet in rounds, before those still apart meet one by one
SHORT = 32  # lists up to this length are searched for members that can link with none
SUBSETS = 600  # at most so many pairs are enumerated for a set
CLASSES = float(np.log(4 / 3))  # sizes of linked sets differ by this factor at most

_U = np.uint64
_SHIFT = _U(64 - CELL_BITS)


def needed(size):
    """The least number of shingles that a set of this size shares with any set it links with."""
    return -(-3 * size // 4)


def prefix_length(size, subset: int):
    """So many first shingles hold ``subset`` common ones for any linked set (as many as there are, if fewer)."""
    return np.minimum(size, size - needed(size) + subset)


class Sets:
    """Shingle sets of the texts of a batch, and digests of their word sequences, by which equal texts are known."""

    def __init__(self, column: pa.Array, digests: bool = True):
        words, bounds = word_hashes(*raw_bytes(column))
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        self.sets = [np.unique(shingle_hashes(words[a:b], WIDTH)) for a, b in spans]
        if digests:
            with np.errstate(over="ignore"):
                place = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1].astype(np.uint64), np.diff(bounds))
                odd = mix(place + _U(7)) | _U(1)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)]) for h in (words * odd, mix(words ^ odd))]
                pair = [(c[bounds[1:]] - c[bounds[:-1]]).view(np.int64).tolist() for c in sums]
            self.digests = list(zip(*pair))


# --- sizes, equal texts and the frequency sketch ---------------------------------------------------

_SEEN = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.int32()), ("cells", pa.binary())])


def _packed(cells: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(cells.astype("<u4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")


def _survey(docs: DataFrame) -> DataFrame:
    """One row per document (id, set size, digest of its words), and rows with pieces of the sketch."""

    def scan(parts):
        cells, used = np.zeros(CELLS, np.uint32), False
        for part in sliced(parts):
            found = Sets(part.column("text"))
            if any(map(len, found.sets)):
                cells += np.bincount((np.concatenate(found.sets) >> _SHIFT).astype(np.int64), minlength=CELLS).astype(np.uint32)
                used = True
            n = part.num_rows
            yield arrow_rows(_SEEN, [part.column("doc_id"), [len(s) for s in found.sets], [d[0] for d in found.digests], [d[1] for d in found.digests], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())])
        if used:
            rows = cells.reshape(-1, CHUNK)
            n = len(rows)
            none = pa.nulls(n, pa.int64())
            yield arrow_rows(_SEEN, [none, none, none, none, list(range(n)), [_packed(r) for r in rows]])

    return docs.mapInArrow(scan, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, chunk int, cells binary")


def _levels(survey: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(level of every cell, whether its lists may be very long, mean length of the list a posting meets) from the summed sketch.

    Cells hold the counts of many shingles. What a cell has above the mean is one frequent
    shingle; its level is the power of two by which it stands out of the noise, 0 for the rest. The levels
    only order shingles, so wrong ones cost time, never a link.
    """
    pieces = survey.where("cells is not null").select("chunk", "cells", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(32)).alias("salt"))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for b in table.column("cells"):
            total += _unpacked(b.as_py())
        return pa.table({"chunk": table.column("chunk")[:1], "cells": pa.array([_packed(total.astype(np.uint32))], pa.binary())})

    # two steps, so that a group has few rows however many tasks there were
    pieces = pieces.groupBy("chunk", "salt").applyInArrow(add, "chunk int, cells binary").groupBy("chunk").applyInArrow(add, "chunk int, cells binary")
    cells = np.zeros(CELLS, np.uint32)
    for row in pieces.collect():  # CELLS counters, whatever the corpus
        cells[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = _unpacked(bytes(row.cells))
    return leveled(cells)


def leveled(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What ``_levels`` returns, a chunk at a time: in the driver nothing wider than the counters themselves is held for all cells."""
    noise = float(np.median(cells))
    spread = max(1.0, float(np.sqrt(noise)))
    level, hot, squares = np.empty(len(cells), np.uint8), np.empty(len(cells), bool), 0.0
    for at in range(0, len(cells), CHUNK):
        part = slice(at, at + CHUNK)
        over = np.maximum(cells[part] - noise, 0.0)
        level[part] = np.floor(np.where(over > 4 * spread, 1 + np.log2(np.maximum(over / (4 * spread), 1.0)), 0.0))
        hot[part], squares = over > HOT, squares + float((over**2).sum())
    return level, hot, squares / max(1.0, float(cells.sum(dtype=np.uint64)))


def boundary(mean_list: float) -> int:
    """The largest set size for which enumerating pairs costs no more than scanning single lists.

    A pair costs a posting; a single shingle a posting and the list it meets. Pairs grow with
    the square of the prefix, so there is one crossing, also held by SUBSETS.
    """
    best = 1
    for size in range(2, 400):
        two, one = int(prefix_length(size, 2)), int(prefix_length(size, 1))
        pairs = two * (two - 1) // 2
        if pairs <= one * (1 + mean_list) and pairs <= SUBSETS:
            best = size
    return best


# --- postings -----------------------------------------------------------------------------------------

_POST = np.dtype([("key", "<u8"), ("doc", "<i8"), ("size", "<i4"), ("place", "<i4")])


def postings(ids: np.ndarray, sets: list[np.ndarray], level: np.ndarray, hot: np.ndarray, light: int) -> np.ndarray:
    """Postings (key, document, set size, place of the key in the ordered set) of a batch.

    A set up to ``light`` posts the pairs of its prefix of two; a larger one, or one that can
    link with a larger one, posts single shingles. A set of one shingle posts it. The place of a
    key whose list may be very long is marked by a negative sign.
    """
    keys, docs, sizes, places = [], [], [], []
    for doc, s in zip(ids, sets):
        n = len(s)
        if n == 0:
            continue
        rank = level[(s >> _SHIFT).astype(np.int64)]
        order = np.lexsort((s, rank)) if rank.any() else slice(None)  # sets are sorted by hash already
        ordered = s[order]
        made = []
        if n == 1 or n > light or 4 * n >= 3 * (light + 1):
            p = int(prefix_length(n, 1))
            long = hot[(ordered[:p] >> _SHIFT).astype(np.int64)]
            made.append((mix(ordered[:p] ^ _U(1)), np.where(long, -1 - np.arange(p), np.arange(p))))
        if 2 <= n <= light:
            p = int(prefix_length(n, 2))
            i, j = np.triu_indices(p, 1)
            with np.errstate(over="ignore"):
                pair = mix(ordered[i] * _U(0xD6E8FEB86659FD93) + ordered[j])
            long = hot[(ordered[i] >> _SHIFT).astype(np.int64)] & hot[(ordered[j] >> _SHIFT).astype(np.int64)]
            made.append((pair, np.where(long, -1 - j, j)))
        for k, at in made:
            keys.append(k)
            places.append(at)
            docs.append(np.full(len(k), doc, np.int64))
            sizes.append(np.full(len(k), n, np.int32))
    out = np.empty(sum(map(len, keys)), _POST)
    if len(out):
        out["key"], out["doc"], out["size"], out["place"] = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes), np.concatenate(places)
    return out


_PART = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("rows", pa.binary())])
_LIST = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("hot", pa.bool_()), ("open", pa.bool_()), ("hub", pa.int64())])


def _packed_rows(rows: np.ndarray) -> bytes:
    """Postings column by column, ids as differences, bytes of equal weight together; the keys stay as they are."""
    import zstandard

    def planes(x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()

    rest = planes(np.diff(rows["doc"], prepend=np.int64(0))) + planes(rows["size"]) + planes(rows["place"])
    return np.ascontiguousarray(rows["key"]).tobytes() + zstandard.ZstdCompressor(level=1).compress(rest)


def _unpacked_rows(data: bytes, n: int) -> np.ndarray:
    import zstandard

    rest = zstandard.ZstdDecompressor().decompress(memoryview(data)[8 * n :])

    def planes(at: int, kind: str, width: int) -> np.ndarray:
        cut = np.frombuffer(rest, np.uint8, n * width, at * n).reshape(width, n)
        return np.ascontiguousarray(cut.T).view(kind).ravel()

    out = np.empty(n, _POST)
    out["key"] = np.frombuffer(data, np.uint64, n)
    out["doc"], out["size"], out["place"] = np.cumsum(planes(0, "<i8", 8)), planes(8, "<i4", 4), planes(12, "<i4", 4)
    return out


def partnered(rows: np.ndarray, edge: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of postings in lists (their starts and lengths), whether another member can link at all; true in lists longer than SHORT."""
    met = np.ones(len(rows), bool)
    for m in range(2, SHORT + 1):
        at = edge[count == m]
        step = max(1, 4_000_000 // (m * m))
        for lo in range(0, len(at), step):
            which = at[lo : lo + step, None] + np.arange(m)
            size, doc = rows["size"][which].astype(np.int64), rows["doc"][which]
            rest = size - 1 - rows["place"][which]
            x, y = size[:, :, None], size[:, None, :]
            can = (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)) & (doc[:, :, None] != doc[:, None, :])
            can &= 7 * (2 + np.minimum(rest[:, :, None], rest[:, None, :])) >= 3 * (x + y)
            met[which] = can.any(axis=2)
    return met


def hub_pairs(rows: np.ndarray, hubs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of postings of whole lists: the pairs (smaller id, larger id) of every member with the first
    ``hubs`` members, by a hash, of its own and the neighbouring size classes of its list that sizes and
    places allow; and for every posting whether its list has two members or more that are no hubs.
    """
    size = rows["size"].astype(np.int64)
    kind = np.floor(np.log(size) / (CLASSES * 1.001)).astype(np.int64)
    order = np.lexsort((rows["doc"], mix(rows["doc"].view(np.uint64)), kind, rows["key"]))
    rows, size, kind = rows[order], size[order], kind[order]
    key, doc, rest = rows["key"], rows["doc"], size - 1 - rows["place"]
    n = len(rows)
    fresh = np.ones(n, bool)
    fresh[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    start = np.flatnonzero(fresh)
    group, end = np.cumsum(fresh) - 1, np.append(start[1:], n)
    found = [np.empty((0, 2), np.int64)]
    for step in (-1, 0, 1):
        other = group + step
        near = np.flatnonzero((other >= 0) & (other < len(start)))
        first = start[other[near]]
        near, first = (x[(key[first] == key[near]) & (abs(kind[first] - kind[near]) <= 1)] for x in (near, first))
        for k in range(hubs):
            inside = first + k < end[group[first]]
            x, y = near[inside], first[inside] + k
            can = (4 * np.minimum(size[x], size[y]) >= 3 * np.maximum(size[x], size[y])) & (doc[x] != doc[y])
            can &= 7 * (2 + np.minimum(rest[x], rest[y])) >= 3 * (size[x] + size[y])
            x, y = doc[x[can]], doc[y[can]]
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
    plain = np.arange(n) - start[group] >= hubs
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    left = np.empty(n, bool)
    left[order] = (np.add.reduceat(plain.astype(np.int64), np.flatnonzero(first)) > 1)[np.cumsum(first) - 1] if n else False
    return np.unique(np.concatenate(found), axis=0), left


def _lists(docs: DataFrame, level: np.ndarray, hot: np.ndarray, light: int, parts: int) -> DataFrame:
    """The postings of keys that two documents or more share (key, doc, size, place), and pairs of members with hubs (doc, hub).

    Postings travel packed, a row per batch and part. Keys of frequent shingles may have lists
    of any length: they are dealt over several parts by document as well, marked as ``hot``, and
    left to the joins that follow, which can split them. Other lists are whole in their part, where their
    members meet the hubs. ``open`` are postings with which more may link than the hubs of their list.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((level, hot))

    def post(batches):
        seen: set = set()
        for part in sliced(batches):
            found = Sets(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            take = []
            for i, d in enumerate(found.digests):  # equal texts of a task post once
                if ids[i] is not None and d not in seen:
                    take.append(i)
                    if len(seen) < 500_000:
                        seen.add(d)
            rows = postings(np.array([ids[i] for i in take], np.int64), [found.sets[i] for i in take], *shared.value, light)
            spread = np.where(rows["place"] < 0, mix(rows["doc"].view(np.uint64)), _U(0))
            where = ((rows["key"] ^ spread) % _U(parts)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            rows, where = rows[order], where[order]
            edge = np.flatnonzero(np.diff(where, prepend=-1)).tolist()
            spans = list(zip(edge, [*edge[1:], len(rows)]))
            yield arrow_rows(_PART, [where[edge].tolist(), [b - a for a, b in spans], [_packed_rows(rows[a:b]) for a, b in spans]])

    def gather(table: pa.Table) -> pa.Table:
        rows = np.concatenate([_unpacked_rows(b.as_py(), n.as_py()) for b, n in zip(table.column("rows"), table.column("n"))])
        rows = rows[np.argsort(rows["key"], kind="stable")]
        count = np.diff(np.append(np.flatnonzero(np.diff(rows["key"], prepend=rows["key"][:1] + _U(1))), len(rows)))
        rows = rows[np.repeat(count > 1, count) | (rows["place"] < 0)]
        edge = np.flatnonzero(np.diff(rows["key"], prepend=rows["key"][:1] + _U(1)))
        long = rows["place"] < 0
        left = partnered(rows, edge, np.diff(np.append(edge, len(rows)))) & ~long
        pairs, left[left] = hub_pairs(rows[left], hubs)
        rows["place"][long] = -1 - rows["place"][long]
        none = pa.nulls(len(rows), pa.int64())
        columns = [np.ascontiguousarray(rows["key"]).view(np.int64), rows["doc"], rows["size"], rows["place"], long, left | long, none]
        met = [pa.nulls(len(pairs), f.type) for f in _LIST]
        met[1], met[-1] = pa.array(pairs[:, 0]), pa.array(pairs[:, 1])
        return pa.Table.from_batches([arrow_rows(_LIST, [c if c is none else pa.array(c) for c in columns]), arrow_rows(_LIST, met)])

    hubs = HUBS
    packed = docs.mapInArrow(post, "part int, n int, rows binary")
    return packed.groupBy("part").applyInArrow(gather, "key bigint, doc bigint, size int, place int, hot boolean, open boolean, hub bigint")


# --- links ---------------------------------------------------------------------------------------------


def _can_link(a: str, b: str):
    """What sizes and places allow: common shingles can only follow the first common ones (at most two of them before)."""
    size, rest = f"{a}.size", f"{a}.size - 1 - {a}.place"
    return F.expr(
        f"4 * least({size}, {b}.size) >= 3 * greatest({size}, {b}.size)"
        f" and 7 * (2 + least({rest}, {b}.size - 1 - {b}.place)) >= 3 * ({size} + {b}.size) and {a}.doc <> {b}.doc"
    )


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def _classed(lists: DataFrame) -> DataFrame:
    return lists.withColumn("class", F.floor(F.log("size") / (CLASSES * 1.001)).cast("int"))


def _near_classes(classed: DataFrame) -> DataFrame:
    return classed.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """Every member of a list with the list's hubs of its own and the neighbouring size class, as ``hub_pairs``, for lists of any length."""
    classed = _classed(lists)
    first = Window.partitionBy("key", "class").orderBy(F.xxhash64("doc"), "doc")
    hubs = classed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= HUBS).drop("n").alias("y")
    return _pairs(_near_classes(classed).alias("x").join(hubs, ["key", "class"]).where(_can_link("x", "y")))


def _opened(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components: every member with its component, and whether that is another than the list's largest."""
    posts = lists.select("key", "doc", "size", "place")
    known = posts.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    groups = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    apart = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max_by("component", F.struct("n", "component")).alias("main")).where("groups > 1")
    return stored(known.join(apart, "key").select("key", "doc", "size", "place", "component", F.expr("component <> main").alias("outside")), "join_open")


def _open_pairs(opened: DataFrame, seed: int = 0, leaders: int | None = None) -> DataFrame:
    """Members of a list outside its largest component, with members of its other components.

    With ``leaders``, of every size class only so many members, the first by a hash: as all lists
    take the same order, a member meets the same few leaders in them. Else all members.
    """
    outside, others, keys = opened.where("outside"), opened, ["key"]
    if leaders is not None:
        keys = ["key", "class"]
        order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "doc"), "doc")
        others = _classed(opened).withColumn("n", F.row_number().over(order)).where(F.col("n") <= leaders).drop("n")
        outside = _near_classes(_classed(outside))
    return _pairs(outside.alias("x").join(others.alias("y"), keys).where(_can_link("x", "y") & F.expr("x.component <> y.component")))


def _likely(pairs: DataFrame, posts: DataFrame, light: int) -> DataFrame:
    """The pairs whose prefixes share enough keys to link at all; sets up to ``light`` are small and all stay.

    All common shingles up to the earlier of two prefix ends stand in both prefixes, and behind
    that end the set whose prefix it is has less than ``needed`` shingles left. Only the keys of
    documents in a pair are gathered, if these are few enough to be known to every task.
    """
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    n = ids.count()
    wanted = posts.join(F.broadcast(ids), "doc", "left_semi") if n <= BROADCAST_ROWS else posts
    keys = wanted.groupBy("doc").agg(F.collect_list("key").alias("keys"), F.min("size").alias("least"), F.max("size").alias("most"))
    a = keys.select(F.col("doc").alias("a"), F.col("keys").alias("x"), F.col("least").alias("xl"), F.col("most").alias("xm"))
    b = keys.select(F.col("doc").alias("b"), F.col("keys").alias("y"), F.col("least").alias("yl"), F.col("most").alias("ym"))
    common = F.size(F.array_intersect("x", "y"))
    rest = F.ceil(F.greatest("xm", "ym") * F.lit(0.75)) - 1
    enough = 7 * (common + rest) >= 3 * (F.col("xl") + F.col("yl"))
    return pairs.join(a, "a").join(b, "b").where((F.least("xl", "yl") <= light) | enough).select("a", "b")


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the wanted documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def sets_of(parts):
        for part in sliced(parts):
            yield arrow_rows(schema, [part.column("doc_id"), [s.tobytes() for s in Sets(part.column("text"), digests=False).sets]])

    return docs.join(small_or_shuffled(wanted), "doc_id", "left_semi").mapInArrow(sets_of, "doc_id bigint, shingles binary")


def _linked(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact comparison of their sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(parts):
        for part in parts:
            keep = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
                n, m = len(x) // 8, len(y) // 8
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 75 * (n + m - common))
            yield arrow_rows(schema, [part.column("a").filter(pa.array(keep, pa.bool_())), part.column("b").filter(pa.array(keep, pa.bool_()))])

    a = arrays.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    b = arrays.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint").distinct()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Words are parted by ASCII white space, A-Z lowered. Fewer than five words are one shingle;
    an empty or null text has none and is its own component. Equal texts are one node of the
    graph, whatever their number. A row without an id links with nothing and has a null
    component; rows that repeat an id are one node, linked by each of their texts, with a row and
    a set size each. Other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = fixed_columns(docs, "doc_id", "text")
    survey = stored(_survey(docs), "join_survey")
    rows = survey.where("cells is null").select("doc_id", "n_shingles", "h1", "h2")
    level, hot, mean_list = _levels(survey)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // (4 * LIST_ROWS) + 1)
    light = boundary(mean_list)
    lists = stored(_lists(docs, level, hot, light, parts), "join_lists")
    posts = lists.where("hub is null").drop("hub")

    def verified(pairs: DataFrame) -> DataFrame:
        likely = stored(_likely(pairs, posts, light), "join_likely")
        if likely.isEmpty():
            return likely
        ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
        return stored(_linked(likely, stored(_arrays(docs, ids), "join_sets")), "join_links")

    met = lists.where("hub is not null").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    if hot.any():
        met = met.union(_hub_pairs(posts.where("hot")))
    tested = stored(met.distinct(), "join_pairs")
    edges = verified(tested)
    opened = _opened(posts.where("open"), components(edges))
    for seed, leaders in enumerate(LEADERS):
        led = stored(_open_pairs(opened, seed, leaders).join(tested, ["a", "b"], "left_anti"), "join_led")
        if led.isEmpty():
            break
        tested, found = tested.union(led), verified(led)
        if not found.isEmpty():
            edges = edges.union(found)
            opened = _opened(opened, components(edges))
    more = stored(_open_pairs(opened).join(tested, ["a", "b"], "left_anti"), "join_more")
    if not more.isEmpty():
        edges = edges.union(verified(more))

    same = rows.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    named = rows.join(same, ["h1", "h2"], "left")
    names = stored(named.where("first is not null").select("doc_id", "first").distinct(), "join_names")
    by = edges.join(names.select(F.col("doc_id").alias("a"), F.col("first").alias("x")), "a").join(names.select(F.col("doc_id").alias("b"), F.col("first").alias("y")), "b")
    labels = stored(components(by.select(F.col("x").alias("a"), F.col("y").alias("b"))), "join_labels")
    done = named.join(labels.withColumnRenamed("node", "first"), "first", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "first"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that of the smallest id; columns as they were.

    Rows without an id or without words all stay. Where rows repeat a kept id, one of them stays.
    """
    linked = stored(link(docs), "join_result")
    kept = linked.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(small_or_shuffled(kept), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        named = named.where(blank).unionByName(named.where(~blank).dropDuplicates(["doc_id"]))
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
