"""Merkle manifest of a dataset by bitmap ranks and keyed slot arrays.

Rows are leaves. Within a group they ascend by id, and where a leaf stands is a rank query: the
ids of a group are held as compressed bitmaps, containers of 65,536 ids that list only the words
of 64 that have a bit, with popcount directories over words and containers. Rows meet the one
container that holds them; no rows are sorted. Groups, containers and words are merged by partial
aggregation, so a group of any size is spread.

The tree is built from slot arrays: the leaves of a block of 3**7 slots are put to their places
and reduced seven levels in one task; block nodes are the leaves of the next round. On the way
back every block takes the path of its node and gives each of its leaves the siblings below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionrank.llm.common import small_or_shuffled, stored
from sessionrank.operators.ordering import running_within

FAN = 3
LEVELS = 7  # of a block; 3**7 rows at most are in one task's hands at a time
WORD, CONTAINER = 6, 16  # bits of an id inside a word, and inside a container
BROADCAST_CONTAINERS = 1000  # at most about 20 KB each
REPEATS = 100_000  # equal rows that one row is spread into at a time
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- leaves -----------------------------------------------------------------------------------


def framed(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a hyphen. Integers are decimal."""
    body = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the framed values, one after another."""
    return F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256)


def columns_of(docs: DataFrame) -> dict[str, Column]:
    """The hashed columns of documents; missing ones are null."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    return {c: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")) for c in FIELDS}


# --- ranks --------------------------------------------------------------------------------------


def _shift(value: str, bits: int) -> Column:
    return F.shiftright(F.col(value), bits)


def _left(number: int, value: Column) -> Column:
    """A number shifted by the low six bits of a value."""
    return F.call_function("shiftleft", F.lit(number).cast("bigint"), value.bitwiseAND(63).cast("int"))


def _bit(value: Column) -> Column:
    """The bit that the low six bits of a value name."""
    return _left(1, value)


def _below(bits: Column, value: Column) -> Column:
    """How many bits stand below the one that a value names."""
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(_left(-1, value)))).cast("bigint")


def bitmaps(ids: DataFrame) -> DataFrame:
    """Containers of the ids of every group, from (key, doc_id) without nulls.

    key, chunk, n (rows), bits (the words that have a bit), before (rows in the container before each of them),
    top and top_before (which of the 1,024 words those are, as 16 words, and how many before each), repeated (its words that hold an id twice).
    """
    words = ids.groupBy("key", _shift("doc_id", WORD).alias("word")).agg(F.bit_or(_bit(F.col("doc_id"))).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = words.withColumn("chunk", _shift("word", CONTAINER - WORD)).withColumn("at", F.col("word").bitwiseAND((1 << (CONTAINER - WORD)) - 1))
    # a container has at most 1,024 words
    inside = Window.partitionBy("key", "chunk").orderBy("at")
    words = words.select("*", (F.row_number().over(inside) - 1).alias("i"), (F.sum("n").over(inside) - F.col("n")).alias("before"))
    listed = F.array_sort(F.collect_list(F.struct("i", "bits", "before")))
    tops = range(1 << (CONTAINER - 2 * WORD))
    here = [_shift("at", WORD) == j for j in tops]
    twice = F.when(F.col("n") > F.bit_count("bits"), F.struct("word", "before"))
    made = words.groupBy("key", "chunk").agg(
        F.sum("n").alias("n"),
        listed.alias("listed"),
        F.array(*[F.coalesce(F.bit_or(F.when(h, _bit(F.col("at")))), F.lit(0).cast("bigint")) for h in here]).alias("top"),
        F.array(*[F.coalesce(F.min(F.when(h, F.col("i"))), F.lit(0)) for h in here]).alias("top_before"),
        F.collect_list(twice).alias("repeated"),
    )
    return made.select("key", "chunk", "n", F.col("listed.bits").alias("bits"), F.col("listed.before").alias("before"), "top", "top_before", "repeated")


def rank(ident: Column) -> Column:
    """Rows of a container before the one with this id, from its bitmap and directories."""
    at = F.shiftright(ident, WORD).bitwiseAND((1 << (CONTAINER - WORD)) - 1)
    j = F.shiftright(at, WORD).cast("int")
    i = (F.get("top_before", j) + _below(F.get("top", j), at)).cast("int")
    return F.get("before", i) + _below(F.get("bits", i), ident)


def _spread(rows: DataFrame, n: str, out: str) -> DataFrame:
    """Every row ``n`` times, numbered from 0; many repeats are cut into pieces that several tasks make."""
    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / REPEATS))))
    first = F.col("_piece") * REPEATS
    return pieces.repartition(*[F.col(c) for c in ("key", "doc_id", "_piece")]).withColumn(out, F.explode(F.sequence(first, F.least(F.col(n), first + REPEATS) - 1))).drop("_piece")


def placed(docs: DataFrame, group: Column, ident: Column, value: Column, carried: Mapping[str, Column]) -> DataFrame:
    """key, doc_id, leaf, the carried columns, slot (from 0, gapless in a group) and total (rows of the group)."""
    key = F.coalesce(F.concat(F.lit("1"), group), F.lit("0"))  # null first, then by bytes
    ids = docs.select(key.alias("key"), ident.alias("doc_id"))
    groups = stored(ids.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("doc_id").isNull()).alias("nameless")), "groups")
    containers = stored(bitmaps(ids.where("doc_id is not null")), "bitmaps")
    directory = running_within(containers, ["key"], [F.col("chunk").asc()], {"upto": F.col("n")})
    directory = stored(directory.join(groups, "key").withColumn("start", F.col("nameless") + F.col("upto") - F.col("n")), "directory")
    rows = docs.select(key.alias("key"), ident.alias("doc_id"), value.alias("leaf"), *[c.alias(name) for name, c in carried.items()])
    rows = rows.withColumn("word", _shift("doc_id", WORD)).withColumn("chunk", _shift("doc_id", CONTAINER))
    keep = ["key", "doc_id", "leaf", *carried, "slot", "total"]
    # words with repeated ids, and rows without an id, are set apart: ties go by leaf, and equal rows are counted first
    ties = directory.select("key", "total", "start", F.inline("repeated")).select("key", "word", (F.col("start") + F.col("before")).alias("start"), "total")
    ties = ties.union(groups.where("nameless > 0").select("key", F.lit(None).cast("bigint"), F.lit(0).cast("bigint"), "total"))
    ties = stored(ties, "ties")
    n_ties, tied = ties.count(), None
    plain = rows.where("doc_id is not null")
    if n_ties:
        few = small_or_shuffled(ties.withColumnsRenamed({"key": "tie_key", "word": "tie_word"}), n_ties)
        match = (F.col("key") == F.col("tie_key")) & F.col("word").eqNullSafe(F.col("tie_word"))
        plain = plain.join(few, match, "left_anti")
        same = rows.join(few, match).groupBy("key", "word", "doc_id", "leaf", *carried, "start", "total").agg(F.count(F.lit(1)).alias("n"))
        order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), *[F.col(c).asc_nulls_first() for c in carried]]
        after = running_within(same, ["key", "word"], order, {"upto": F.col("n")})
        tied = _spread(after, "n", "copy").withColumn("slot", F.col("start") + F.col("upto") - F.col("n") + F.col("copy")).select(*keep)
    found = plain.join(small_or_shuffled(directory, bound=BROADCAST_CONTAINERS), ["key", "chunk"])
    found = found.withColumn("slot", F.col("start") + rank(F.col("doc_id"))).select(*keep)
    return found if tied is None else found.unionByName(tied)


# --- trees ----------------------------------------------------------------------------------------


def levels_of(total: int) -> int:
    """Levels above ``total`` leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // FAN), n + 1
    return n


def layers(nodes: list[str], levels: int) -> list[list[str]]:
    """A row of nodes and the ``levels`` rows above it."""
    made = [nodes]
    for _ in range(levels):
        last = made[-1]
        made.append([hashlib.sha256("".join(last[i : i + FAN]).encode()).hexdigest() for i in range(0, len(last), FAN)])
    return made


def _slots(table: pa.Table, levels: int) -> tuple[list[str], list[int], int]:
    """The slot array of a block, the place of every row in it, and the levels above its nodes that the block makes."""
    size, total = FAN**levels, table.column("total")[0].as_py()
    place = [s % size for s in table.column("slot").to_pylist()]
    nodes: list[str | None] = [None] * len(place)
    for at, h in zip(place, table.column("leaf").to_pylist()):
        if at >= len(nodes) or nodes[at] is not None:
            raise ValueError("slots of a block are not gapless")
        nodes[at] = h
    return nodes, place, min(levels, levels_of(total))


def _reduce(levels: int):
    def reduced(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes, _, made = _slots(table, levels)
        total = -(-table.column("total")[0].as_py() // FAN**levels)
        found = {"key": [key[0].as_py()], "slot": [key[1].as_py()], "leaf": layers(nodes, made)[-1], "total": [total]}
        return pa.table(found, pa.schema([("key", pa.string()), ("slot", pa.int64()), ("leaf", pa.string()), ("total", pa.int64())]))

    return reduced


def _block(levels: int) -> Column:
    return F.floor(F.col("slot") / F.lit(FAN**levels)).cast("bigint").alias("block")


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes (key, slot, leaf, total) of a forest, round by round, up to one root a tree; all but the given ones are written."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > 1:
        part = rounds[-1].select("key", _block(levels), "slot", "leaf", "total")
        rounds.append(stored(part.groupBy("key", "block").applyInArrow(_reduce(levels), "key string, slot bigint, leaf string, total bigint"), "nodes"))
    return rounds


PATH = "array<struct<before:string,after:string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _paths(names: list[str], levels: int):
    """Gives the rows of a block the siblings on their way up, in the block and above it."""

    def paths(below: pa.Table, above: pa.Table) -> pa.Table:
        if below.num_rows == 0:
            return pa.table([pa.array([], below.schema.field(c).type) for c in names] + [pa.array([], _PATH)], names=[*names, "path"])
        nodes, place, made = _slots(below, levels)
        rows = layers(nodes, made)[:made]
        rest = above.column("path")[0].as_py()
        over = ([p["before"] for p in rest], [p["after"] for p in rest])
        befores, afters = [], []
        for at in place:
            for row in rows:
                run = at - at % FAN
                befores.append("".join(row[run:at]))
                afters.append("".join(row[at + 1 : run + FAN]))
                at //= FAN
            befores += over[0]
            afters += over[1]
        pairs = pa.StructArray.from_arrays([pa.array(befores, pa.string()), pa.array(afters, pa.string())], names=["before", "after"])
        path = pa.ListArray.from_arrays(pa.array([i * (made + len(rest)) for i in range(len(place) + 1)], pa.int32()), pairs)
        return pa.table([below.column(c) for c in names] + [path], names=[*names, "path"])

    return paths


def descend(rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows of the first round with their paths, given the paths (key, slot, path) of the last one's nodes."""
    for nodes in reversed(rounds[:-1]):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + f", path {PATH}"
        ways = above.select("key", F.col("slot").alias("block"), "path").groupBy("key", "block")
        above = nodes.select("*", _block(levels)).groupBy("key", "block").cogroup(ways).applyInArrow(_paths(nodes.columns, levels), schema)
    return above


def manifest(docs: DataFrame, carried: Mapping[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, path and the ``carried`` columns (expressions over ``docs``, of sortable types) of every row of ``docs``.

    A leaf is the hash of (doc_id, source, lang, n_chars, text). In every source the leaves
    ascend by doc_id; while there is more than one node, each three in a row, fewer at the end,
    become the hash of their hex digests. The last one is the source's subroot, and subroots
    ascending by source, null first, give the root in the same way. path lists, from the leaf up
    to the root, the digests that stand before and after the node on its way in its run.

    Null sources are a source. Rows without doc_id come first in theirs; these, and rows that
    share doc_id and source, go by leaf, then by the carried columns; equal rows have slots of
    their own. Null and empty texts are different leaves. Columns that are missing count as
    null, other ones are not read. No rows give no rows. ``docs`` is read three times and must
    give the same rows each time.
    """
    carried = dict(carried or {})
    names = {name: f"c_{i}" for i, name in enumerate(carried)}
    of = columns_of(docs)
    leaves = stored(placed(docs, of["source"], of["doc_id"], leaf(*of.values()), {names[n]: c for n, c in carried.items()}), "slots")
    rounds = climb(leaves, levels)
    subroots = rounds[-1].select("key", F.col("leaf").alias("subroot"))
    place = running_within(subroots, [], [F.col("key").asc()], {"place": F.lit(1).cast("bigint")})
    total = subroots.count()
    top = stored(place.select(F.lit("").alias("key"), (F.col("place") - 1).alias("slot"), F.col("subroot").alias("leaf"), F.lit(total).cast("bigint").alias("total"), F.col("key").alias("group")), "subroots")
    over = climb(top, levels)
    last = over[-1].select("leaf").first()
    root = F.lit(last[0] if last else None).cast("string")
    ways = descend(over, over[-1].select("key", "slot", F.array().cast(PATH).alias("path")), levels)
    if len(over) == 1:  # one source
        ways = ways.join(top.select("key", "slot", "group", "leaf"), ["key", "slot"])
    ways = stored(ways.select(F.col("group").alias("key"), F.lit(0).cast("bigint").alias("slot"), "path", F.col("leaf").alias("subroot")), "ways")
    if len(rounds) == 1:  # one row a source
        found = leaves.join(ways.select("key", "path"), "key")
    else:
        found = descend(rounds, ways, levels)
    found = found.join(small_or_shuffled(ways.select("key", "subroot"), total), "key")
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "path", *[F.col(names[n]).alias(n) for n in carried])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]).cast("binary"), 256))
