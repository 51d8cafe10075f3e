"""Benchmark decontamination by multi-pattern search after Wu and Manber.

The windows of the benchmark, runs of words between single spaces, are the patterns. Patterns are
parted into classes by length. For a class whose shortest pattern has m bytes, a table over hashed
blocks of B bytes says how far the end of a window of m bytes may move on before any pattern can
begin with it. Positions that no shift skips select, by the hash of their last block, the patterns
that could begin there, and these are compared byte by byte. Many cursors run over a text side by
side, each over its own range of positions, so that one numpy step moves all of them.

The benchmark may have any size: its (window, item) pairs are dealt to blocks of bounded size by
hash, and the documents pass the blocks one after another; spans and items add up.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrank.llm.common import raw_bytes, stored

WINDOW = 10  # words
BLOCK_BYTES = 32 << 20  # windows and item ids that one pass over the documents searches for
CLASSES = (1, 8, 16, 32)  # least lengths of patterns, in bytes
SPAN = 512  # positions of a cursor
SLICE = 4 << 20  # positions searched at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
START = 1  # stands before every text; no pattern holds it


# --- patterns -----------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """The words of a text: A-Z lowered, then runs of 0-9, a-z and all characters beyond ASCII."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The distinct (window, item_id): ``width`` words in a row with spaces around each, fewer where an item has fewer."""
    rows = benchmark.select(F.col("`item_id`").cast("bigint").alias("item_id"), words(F.col("`text`").cast("string")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i + 1, width), " "), F.lit(" ")))
    return rows.select(F.explode(window).alias("window"), "item_id").distinct()


@dataclass(frozen=True)
class Class:
    """Search tables of the patterns of one class of lengths."""

    least: int  # m: length of the shortest one
    block: int  # B
    bits: int
    shift: np.ndarray  # by block hash: positions to move on
    first: np.ndarray  # by block hash: where its patterns stand in ``bucket``
    bucket: np.ndarray  # pattern numbers, ordered by the hash of their m-th byte's block


@dataclass(frozen=True)
class Patterns:
    body: np.ndarray  # all patterns, one after another
    start: np.ndarray
    words: np.ndarray  # words of each
    item_first: np.ndarray  # where the items of a pattern stand in ``items``
    items: np.ndarray
    known: np.ndarray  # whether the item has an id
    classes: tuple[Class, ...]


def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((keys ^ (keys >> np.uint64(29))) * _GOLD) >> np.uint64(64 - bits)).astype(np.int64)


def _keys(body: np.ndarray) -> np.ndarray:
    """At every byte, that byte and the seven after it as one number; ``body`` has eight more bytes at its end."""
    return np.ndarray((len(body) - 7,), "<u8", buffer=body, strides=(1,))


def _masked(keys: np.ndarray, size: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * size)) - 1) if size < 8 else keys


def class_of(body: np.ndarray, start: np.ndarray, chosen: np.ndarray) -> Class:
    """Tables of the chosen patterns. The block is long enough that most blocks of ordinary text begin no pattern."""
    lens = start[chosen + 1] - start[chosen]
    least = int(lens.min())
    entries = 2 * least * len(chosen)
    block = int(min(8, least, max(2, np.ceil(np.log(entries) / np.log(16)))))
    bits = int(min(24, max(10, np.ceil(np.log2(entries)) + 2)))
    keys = _keys(np.append(body, np.zeros(8, np.uint8)))
    shift = np.full(1 << bits, min(255, least - block + 1), np.uint8)
    for place in range(least - block + 1):  # blocks that end least - block - place bytes before the m-th
        h = _hash(_masked(keys[start[chosen] + place], block), bits)
        np.minimum.at(shift, h, min(255, least - block - place))
    h = _hash(_masked(keys[start[chosen] + least - block], block), bits)
    order = np.argsort(h, kind="stable")
    first = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount(h, minlength=1 << bits), out=first[1:])
    return Class(least, block, bits, shift, first, chosen[order])


def patterns(pairs: list[tuple[str, int | None]]) -> Patterns:
    """Search tables of (window, item) pairs."""
    pairs = sorted(set(pairs), key=lambda p: (p[0], p[1] is None, p[1] or 0))
    texts, item_first = [], []
    for i, (w, _) in enumerate(pairs):
        if not texts or texts[-1] != w:
            texts.append(w)
            item_first.append(i)
    coded = [t.encode() for t in texts]
    start = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(t) for t in coded], out=start[1:])
    body = np.frombuffer(b"".join(coded), np.uint8)
    lens, made = np.diff(start), []
    for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62)):
        chosen = np.flatnonzero((lens >= low) & (lens < high))
        if len(chosen):
            made.append(class_of(body, start, chosen))
    items = [i for _, i in pairs]
    return Patterns(
        body, start, np.array([t.count(b" ") - 1 for t in coded], np.int64), np.array([*item_first, len(items)], np.int64),
        np.array([i or 0 for i in items], np.int64), np.array([i is not None for i in items], bool), tuple(made),
    )


# --- search ---------------------------------------------------------------------------------------


def normalised(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts lower-cased with one space before, between and after words; each begins with START. Also where each begins.

    Works in slices; besides the result there are only some bytes for each byte of a slice.
    """
    made, starts, n = [], np.zeros(len(offsets) - 1, np.int64), 0
    for i in range(len(offsets) - 1):
        starts[i], before = n, True
        made.append(np.array([START, 32], np.uint8))
        n += 2
        inside = False
        for a in range(int(offsets[i]), int(offsets[i + 1]), SLICE):
            part = body[a : min(a + SLICE, int(offsets[i + 1]))]
            word = _WORD[part]
            ahead = np.empty(len(part), bool)
            ahead[0], ahead[1:] = inside, word[:-1]
            inside = bool(word[-1])
            kept = np.where(word, _LOWER[part], np.uint8(32))[word | ahead]
            made.append(kept)
            n += len(kept)
        if inside:
            made.append(np.array([32], np.uint8))
            n += 1
    return (np.concatenate(made) if made else np.zeros(0, np.uint8)), starts


def _candidates(keys: np.ndarray, low: int, high: int, c: Class) -> tuple[np.ndarray, np.ndarray]:
    """(position, pattern) for the windows of m bytes beginning in [low, high) that no shift skips; all cursors move at once."""
    at = np.arange(low, high, SPAN)
    end = np.minimum(at + SPAN, high)
    found_at, found_hash = [], []
    while len(at):
        h = _hash(_masked(keys[at + (c.least - c.block)], c.block), c.bits)
        move = c.shift[h].astype(np.int64)
        stop = move == 0
        if stop.any():
            found_at.append(at[stop])
            found_hash.append(h[stop])
            move[stop] = 1
        at = at + move
        live = at < end
        at, end = at[live], end[live]
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, h = np.concatenate(found_at), np.concatenate(found_hash)
    n = (c.first[h + 1] - c.first[h]).astype(np.int64)
    places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(c.first[h], n)
    return np.repeat(at, n), c.bucket[places]


def _equal(text: np.ndarray, at: np.ndarray, which: np.ndarray, p: Patterns) -> np.ndarray:
    """Whether pattern ``which`` stands at ``at``, by comparing their bytes, eight at a time, until one differs."""
    size = p.start[which + 1] - p.start[which]
    alive = np.flatnonzero(at + size <= len(text) - 8)
    theirs, mine = _keys(np.append(p.body, np.zeros(8, np.uint8))), _keys(text)
    same = np.zeros(len(at), bool)
    done = 0
    while len(alive):
        left = size[alive] - done
        a, b = mine[at[alive] + done], theirs[p.start[which[alive]] + done]
        cut = np.where(left < 8, (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        alive, left = (x[((a ^ b) & cut) == 0] for x in (alive, left))
        same[alive[left <= 8]] = True
        alive = alive[left > 8]
        done += 8
    return same


def occurrences(text: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(position, pattern) of all occurrences in a normalised text."""
    padded = np.append(text, np.zeros(8 + max(CLASSES), np.uint8))
    keys = _keys(padded)
    found = []
    for c in p.classes:
        for low in range(0, max(0, len(text) - c.least + 1), SLICE):
            at, which = _candidates(keys, low, min(low + SLICE, len(text) - c.least + 1), c)
            for i in range(0, len(at), SLICE // 8):
                a, w = at[i : i + SLICE // 8], which[i : i + SLICE // 8]
                good = _equal(padded, a, w, p)
                found.append((a[good], w[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([w for _, w in found])


def _runs(covered: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (within its text) and text of every run of covered words; text i owns covered[bounds[i]:bounds[i + 1]]."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[:-1] |= covered
    change = np.zeros(len(covered) + 1, bool)
    change[bounds] = True
    start = edge[:-1] & (~np.append(False, covered[:-1]) | change[:-1])
    stop = edge[:-1] & (~np.append(covered[1:], False) | change[1:])
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    owner = np.searchsorted(bounds, a, side="right") - 1
    return a - bounds[owner], b - bounds[owner], owner


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def searched(column: pa.Array, p: Patterns, spans: pa.Array | None = None, items: pa.Array | None = None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, merged spans of hit words and ids of occurring items of every text, added to what is known of them."""
    body, offsets = raw_bytes(column)
    n = len(offsets) - 1
    text, starts = normalised(body, offsets)
    gaps = np.flatnonzero(text == 32)  # the one before a word has the word's number, plus one for each text before
    bounds = np.searchsorted(gaps, np.append(starts, len(text)))
    n_words = np.diff(bounds) - 1
    cover = np.zeros(len(gaps) + 1, np.int32)
    at, which = occurrences(text, p)
    first = np.searchsorted(gaps, at)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + p.words[which], -1)
    owner = np.searchsorted(starts, at, side="right") - 1
    pair = np.unique(np.stack([owner, which]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
    k = p.item_first[pair[1] + 1] - p.item_first[pair[1]]
    places = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(p.item_first[pair[1]], k)
    named = p.known[places]
    doc_of, item_of = np.repeat(pair[0], k)[named], p.items[places][named]
    if spans is not None:
        flat, sizes = spans.flatten(), np.diff(np.asarray(spans.offsets))
        base = np.repeat(bounds[:-1], sizes)
        np.add.at(cover, base + np.asarray(flat.field("start")), 1)
        np.add.at(cover, base + np.asarray(flat.field("end")), -1)
        doc_of = np.concatenate([doc_of, np.repeat(np.arange(n), np.diff(np.asarray(items.offsets)))])
        item_of = np.concatenate([item_of, np.asarray(items.flatten())])
    a, b, run_of = _runs(np.cumsum(cover[:-1]) > 0, bounds)
    both = np.unique(np.stack([doc_of, item_of]), axis=1) if len(doc_of) else np.zeros((2, 0), np.int64)

    def ends(owners):
        return pa.array(np.append(0, np.cumsum(np.bincount(owners, minlength=n)[:n])).astype(np.int32), pa.int32())

    runs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["start", "end"])
    return pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(ends(run_of), runs), pa.ListArray.from_arrays(ends(both[0]), pa.array(both[1], pa.int64()))


OUT = "doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<bigint>"


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans and items of every row of ``docs``.

    spans are the runs of words (start, end, from 0, end exclusive) that lie inside any
    occurrence of a benchmark window, merged where they overlap or touch; items are the ids of
    the items with occurring windows, each once, ascending.

    Null and empty texts have no words; items without words have no windows. Items without an
    id mark words but are not listed; repeated items count once. Repeated documents and null
    ids give a row each. Other columns are not read. No documents give no rows, no items no
    spans. A text is searched whole, whatever its length; one (window, item) is at most ten
    words long, and a block of them holds about ``block_bytes``.
    """
    pairs = stored(windows(benchmark, width), "windows")
    total = pairs.agg(F.sum(F.octet_length("window") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    for b in range(blocks):
        found = pairs.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == b).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(patterns(list(zip(*(found.column(c).to_pylist() for c in ("window", "item_id"))))))
        last = b == blocks - 1
        rows = rows.mapInArrow(functools.partial(_search, shared, b == 0, last), OUT + ("" if last else ", text string"))
    return rows


def _search(shared, first: bool, last: bool, parts):
    """Adds what one block of windows finds to the rows of a partition; the last one leaves the texts out."""
    p = shared.value
    for part in parts:
        known = () if first else (part.column("spans"), part.column("items"))
        made = searched(part.column("text"), p, *known)
        names = ["doc_id", "n_words", "spans", "items"] + ([] if last else ["text"])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made, *([] if last else [part.column("text")])], names=names)
