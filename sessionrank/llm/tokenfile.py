"""Token ids in binary shards with Re-Pair grammar compression.

Documents are range-partitioned by id, tokenised, and written in blocks of about a million ids.
In every block the most frequent pairs of neighbouring ids are replaced by new symbols, round
after round; the block keeps the rules, the expansion length of every symbol, and the lengths
of its documents, so that a single document can be decoded from the symbols that cover it.
The file format is a Parquet table, one row per block (see ``SCHEMA``); a document never
crosses a block.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionrank.llm.common import arrow_rows, fixed_columns, mix, powers, small_or_shuffled, texts
from sessionrank.session import output_path

BLOCK_IDS = 1_000_000
ROUNDS = 6  # of replacing pairs, at most
LEAST = 16  # a pair must stand so often in a block to get a symbol
HELD = 1_500_000  # encoded pieces of text a worker keeps
HELD_IDS = 8_000_000  # ids of these pieces
SLICE = 1 << 20  # bytes of text looked up at a time
SYMBOLS = 1 << 16
_HASH_BITS, _SLOT_BITS = 20, 22
_U = np.uint64

SCHEMA = "shard int, block int, n_docs int, n_ids bigint, terminals int, doc_ids array<bigint>, lengths array<int>, rules binary, expansions binary, symbols binary"
_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("terminals", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("rules", pa.binary()), ("expansions", pa.binary()), ("symbols", pa.binary()),
])


# --- grammar ------------------------------------------------------------------------------------


def compress(ids: np.ndarray, terminals: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, expansion lengths of the rules); rule k is the pair that symbol terminals + k stands for.

    Every round counts all neighbouring pairs, gives symbols to the frequent ones, the most
    frequent first, and replaces them from the left without overlap.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = terminals
    size = np.ones(SYMBOLS, np.int64)
    where = np.zeros(1 << _HASH_BITS, np.int32)  # 1 + number of the chosen pair that hashes to a cell
    for _ in range(rounds):
        room = SYMBOLS - made
        if room <= 0 or len(seq) < 2:
            break
        pair = (seq[:-1] << np.uint32(16)) | seq[1:]
        ordered = np.sort(pair)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(edge, append=len(ordered))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        # an early round takes its share of the room, so that later ones can build on its symbols
        take = max(1, min(len(often), max(room // 3, 256), room))
        often = often[np.argsort(-count[often], kind="stable")[:take]]
        chosen = ordered[edge[often]]
        # of pairs that share a cell the most frequent one goes first, the others wait for a later round
        cell = _cells(chosen)
        chosen = chosen[np.sort(np.unique(cell, return_index=True)[1])]
        cell = _cells(chosen)
        where[cell] = np.arange(1, len(chosen) + 1)
        at = where[_cells(pair)]
        place = np.flatnonzero(at)
        at = at[place] - 1
        hit = chosen[at] == pair[place]
        place, at = place[hit], at[hit]
        where[cell] = 0
        # of hits in a row, every second one
        number = np.arange(len(place))
        run = number - np.maximum.accumulate(np.where(np.diff(place, prepend=-2) > 1, number, 0))
        place, at = place[run % 2 == 0], at[run % 2 == 0]
        seq[place] = (made + at).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        seq = seq[keep]
        left, right = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        size[made : made + len(chosen)] = size[left] + size[right]
        rules.append(np.stack([left, right], axis=1))
        made += len(chosen)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq.astype("<u2"), flat.astype("<u2"), size[terminals:made].astype("<u4")


def _cells(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - _HASH_BITS)


def _unrolled(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    seq = symbols.astype(np.int64)
    rules = rules.astype(np.int64)
    while True:
        big = seq >= terminals
        if not big.any():
            return seq
        start = np.cumsum(1 + big) - (1 + big)
        out = np.empty(len(seq) + int(big.sum()), np.int64)
        out[start[~big]] = seq[~big]
        pair = rules[seq[big] - terminals]
        out[start[big]], out[start[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int, expansions: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; rules refer to earlier symbols only. With the rules' expansion lengths every rule is unrolled once."""
    if expansions is None or len(symbols) < len(rules):
        return _unrolled(symbols, rules, terminals)
    table = np.concatenate([np.arange(terminals), _unrolled(np.arange(terminals, terminals + len(rules)), rules, terminals)])
    size = np.concatenate([np.ones(terminals, np.int64), expansions.astype(np.int64)])
    return table[_ragged((np.cumsum(size) - size)[symbols], size[symbols])]


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... (``count`` of them) of all items, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def slice_ids(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, terminals: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start``, expanding only the symbols that cover them."""
    if count <= 0:
        return np.zeros(0, np.int64)
    size = np.ones(terminals + len(expansions), np.int64)
    size[terminals:] = expansions
    ends = np.cumsum(size[symbols.astype(np.int64)])
    i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + count, side="left")
    begin = int(ends[i] - size[int(symbols[i])])
    return expand(symbols[i : j + 1], rules, terminals)[start - begin : start - begin + count]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


# --- tokens ---------------------------------------------------------------------------------------


class Encoder:
    """A byte-level tokenizer that remembers the ids of pieces of text, by their 64-bit hashes.

    Its pattern always parts words before a space that a character other than white space
    follows, and never looks behind, so such pieces can be encoded alone. Texts where
    white space follows a space, or that hold the mark of special strings, go to the library whole.
    """

    _WHOLE = re.compile(r" (?:\s|$)|<\|")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.size = self.model.get_vocab_size()
        if self.size > SYMBOLS - 256:
            raise ValueError("ids must fit 16 bits and leave room for rules")
        # ids of the tokens that begin with a space
        self.lead = np.zeros(SYMBOLS, bool)
        self.lead[[i for t, i in self.model.get_vocab().items() if t.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        """An empty table of pieces: open addressing by hash; the ids of piece k are flat[first[k]:][:count[k]]."""
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.first, self.count = np.zeros(1 << _SLOT_BITS, np.int32), np.zeros(1 << _SLOT_BITS, np.int32)
        self.flat, self.used, self.held = np.zeros(1 << 20, "<u2"), 0, 0

    def library(self, body: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.model.encode_batch_fast(body, add_special_tokens=False)]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, or the empty one where it belongs."""
        at = (keys >> _U(64 - _SLOT_BITS)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            seen = self.keys[at[left]]
            left = left[(seen != keys[left]) & (seen != 0)]
            at[left] = (at[left] + 1) & ((1 << _SLOT_BITS) - 1)
        return at

    def _learn(self, keys: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Takes up new pieces of ``data``; those with a space in front are encoded as one text and cut before their spaces."""
        spaced = data[first] == 32
        text = data[_ragged(first[spaced], size[spaced])].tobytes().decode()
        ids = np.frombuffer(self.library([text])[0], "<u2")
        cut = np.flatnonzero(self.lead[ids])
        if len(cut) != int(spaced.sum()):
            raise RuntimeError("a piece does not begin with a token of its own")
        bare = self.library([data[a : a + n].tobytes().decode() for a, n in zip(first[~spaced].tolist(), size[~spaced].tolist())])
        keys = np.concatenate([keys[spaced], keys[~spaced]])
        new = np.concatenate([ids, np.frombuffer(b"".join(bare), "<u2")])
        count = np.concatenate([np.diff(cut, append=len(ids)), np.array([len(x) // 2 for x in bare], np.int64)])
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        first = self.used + np.cumsum(count) - count
        self.used, self.held = self.used + len(new), self.held + len(keys)
        todo = np.arange(len(keys))
        while len(todo):  # of keys that want one slot, one is placed at a time
            slot, one = np.unique(self._slots(keys[todo]), return_index=True)
            self.keys[slot], self.first[slot], self.count[slot] = keys[todo[one]], first[todo[one]], count[todo[one]]
            todo = np.delete(todo, one)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """Hashes of the pieces data[starts[i]:starts[i + 1]], the last one up to ``end``; never 0."""
        base, ends = int(starts[0]), np.append(starts[1:], end)
        if end - base > SLICE:  # one long piece
            return np.frombuffer(hashlib.blake2b(data[base:end].tobytes(), digest_size=8).digest(), "<u8") | _U(1)
        power, inverse = powers(SLICE)
        with np.errstate(over="ignore"):
            sums = np.zeros(end - base + 1, np.uint64)
            np.cumsum(_BYTE[data[base:end]] * power[: end - base], out=sums[1:])
            h = mix(((sums[ends - base] - sums[starts - base]) * inverse[starts - base]) ^ (ends - starts).astype(np.uint64))
        return h | _U(1)

    def encode(self, body: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(body) if self._WHOLE.search(t)]
        done: list[bytes] = [b""] * len(body)
        for i, ids in zip(whole, self.library([body[i] for i in whole])):
            done[i] = ids
        rest = np.setdiff1d(np.arange(len(body)), whole).tolist()
        raw = [body[i].encode() for i in rest]
        lens = np.array([len(r) for r in raw], np.int64)
        offsets = np.append(0, np.cumsum(lens)).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        begins = data == 32
        begins[offsets[:-1][lens > 0]] = True
        starts = np.flatnonzero(begins)
        ids, counts, i = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE, side="right")) - 1)
            if starts[-1] < starts[i] + SLICE and len(data) <= starts[i] + SLICE:
                j = len(starts)
            if self.held > HELD or self.used > HELD_IDS:
                self._forget()
            some, end = starts[i:j], int(starts[j]) if j < len(starts) else len(data)
            keys = self._hashes(data, some, end)
            at = self._slots(keys)
            new = np.flatnonzero(self.keys[at] == 0)
            if len(new):
                key, one = np.unique(keys[new], return_index=True)
                one = new[one]
                self._learn(key, data, some[one], np.append(some[1:], end)[one] - some[one])
                at[new] = self._slots(keys[new])
            counts.append(self.count[at].astype(np.int64))
            ids.append(self.flat[_ragged(self.first[at].astype(np.int64), counts[-1])])
            i = j
        flat, upto = np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(counts)))
        edge = upto[np.searchsorted(starts, offsets)].tolist()
        for k, i in enumerate(rest):
            done[i] = flat[edge[k] : edge[k + 1]].tobytes()
        return done


_LOADED: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    """One encoder for a Python worker, kept from task to task."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


# --- files ------------------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 0, block_ids: int = BLOCK_IDS, path: str | None = None) -> str:
    """Write the ids of all texts, each document followed by ``end_id``, and return the path.

    Documents stand in ascending doc_id order over (shard, block, place), null ids first, rows of one id in
    order of their texts' hash and text. A null or empty text has the end id alone; repeated
    rows are written each; no rows give an empty table. Other columns are not read.
    """
    path = path or output_path(docs.sparkSession, "token_ids")

    def blocks(parts):
        model, end = loaded(tokenizer_path), np.array([end_id], "<u2").tobytes()
        shard = _partition_number()
        held: list[bytes] = []
        names: list = []
        n, block = 0, 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u2")
            symbols, rules, sizes = compress(ids, model.size)
            return arrow_rows(_ARROW, [[shard], [block], [len(names)], [len(ids)], [model.size], [names], [[len(h) // 2 for h in held]], [rules.tobytes()], [sizes.tobytes()], [symbols.tobytes()]])

        for part in parts:
            for name, ids in zip(part.column("doc_id").to_pylist(), model.encode(texts(part.column("text")))):
                held.append(ids + end)
                names.append(name)
                n += len(ids) // 2 + 1
                if n >= block_ids:
                    yield flush()
                    held, names, n, block = [], [], 0, block + 1
        if held:
            yield flush()

    rows = fixed_columns(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "h"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    placed.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def _partition_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read(spark: SparkSession, path: str, dtype: str = "<u4") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as ``dtype``) of every document in the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # block starts inside a shard, and shard starts over the few shard totals
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("shard_first"))
    firsts = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_first"))
    firsts = firsts.join(shards, "shard").select("shard", "block", (F.col("shard_first") + F.col("block_first")).alias("base"))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(parts):
        for part in parts:
            for row in part.to_pylist():
                rules, sizes = np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["expansions"], "<u4")
                ids = expand(np.frombuffer(row["symbols"], "<u2"), rules, row["terminals"], sizes).astype(dtype)
                sizes = np.array(row["lengths"], np.int64)
                starts = np.cumsum(sizes) - sizes
                sums = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(starts.tolist(), row["lengths"])]
                m = len(sums)
                yield arrow_rows(schema, [[row["shard"]] * m, [row["block"]] * m, row["doc_ids"], starts, row["lengths"], sums])

    decoded = files.mapInArrow(decode, "shard int, block int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    joined = decoded.join(small_or_shuffled(firsts), ["shard", "block"])
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
