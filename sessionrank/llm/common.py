"""Helpers of the training-data operators: stored tables, word and shingle hashing, components, row keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrank.session import output_path

# Arrow batches of texts stay small, so that a task holds few long texts at a time.
RUNTIME = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
# A table of at most so many (id-sized) rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def tuned(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet below the shared folder and read back: lineage is cut, lost executors do no harm."""
    spark = df.sparkSession
    path = output_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it is counted and found small; else as it is, for a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def fixed_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, missing ones as nulls; extra columns of any name cannot clash with the operator's own."""
    kinds = {"doc_id": "bigint", "vec_id": "bigint", "text": "string", "source": "string", "embedding": "array<float>"}
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])


# --- texts in Arrow batches ---------------------------------------------------------------------


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets); a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at - at[0]


def sliced(parts: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text, a longer text by itself."""
    for part in parts:
        ends = np.cumsum(np.diff(raw_bytes(part.column(column))[1]))
        at = 0
        while at < part.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield part.slice(at, stop - at)
            at = stop


# --- hashing of words and shingles ----------------------------------------------------------------

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BASE = 0x00000100000001B3
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)[_LOWER]


SLICE = 1 << 20  # bytes hashed at a time; the arrays on the way need some sixty bytes for each


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lowered, parted by ASCII white space) of all texts, and each text's first word.

    Returns (hashes, bounds): the words of text i are ``hashes[bounds[i]:bounds[i + 1]]``. Works
    in slices of about a megabyte, cut behind white space or a text; only a longer word makes a longer slice.
    """
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    at, last = 0, len(offsets) - 1
    while at < last:
        # whole texts up to the size of a slice, or one text in pieces
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        if offsets[stop] - offsets[at] <= SLICE:
            h, bounds = _slice_hashes(body[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
            found.append(h)
            counts[at:stop] = np.diff(bounds)
        else:
            for piece in _pieces(body[offsets[at] : offsets[stop]]):
                h, _ = _slice_hashes(piece, np.array([0, len(piece)]))
                found.append(h)
                counts[at] += len(h)
        at = stop
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.append(0, np.cumsum(counts))


def _pieces(text: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end behind white space."""
    start = 0
    while start < len(text):
        end, size = start + SLICE, SLICE
        while end < len(text):
            gaps = np.flatnonzero(_SPACES[text[end - size : end]])
            if len(gaps):
                end = end - size + int(gaps[-1]) + 1
                break
            end += size  # no white space yet: the word goes on
        end = min(end, len(text))
        yield text[start:end]
        start = end


def _slice_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(offsets)
    n = len(body) + len(lens)
    apart = np.full(n, 32, np.uint8)  # a space after each text, so that no word spans two
    if len(body):
        apart[np.arange(len(body)) + np.repeat(np.arange(len(lens)), lens)] = body
    first = offsets[:-1] + np.arange(len(lens))
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACES[apart]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        # sum of byte codes times powers of an odd base, taken back to power 0 by its inverse
        power, inverse = powers(n + 1)
        np.cumsum(_BYTE[apart] * power[:n], out=sums[1:])
        h = mix(((sums[end] - sums[start]) * inverse[start]) ^ ((end - start).astype(np.uint64) * _GOLD))
    return h, np.searchsorted(start, np.append(first, n))


_TABLES: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept between batches up to the size of a slice and its gaps."""
    if len(_TABLES.get("power", ())) >= n:
        return _TABLES["power"], _TABLES["inverse"]
    size, made = 1 << max(16, (n - 1).bit_length()), {}
    for name, value in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
        row = np.full(size, value, np.uint64)
        row[0] = 1
        with np.errstate(over="ignore"):
            made[name] = np.multiply.accumulate(row)
    if size <= 2 * SLICE:
        _TABLES.update(made)
    return made["power"], made["inverse"]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; a shorter text is one run; no words, none."""
    if len(words) == 0:
        return words
    k = max(1, len(words) - width + 1)
    with np.errstate(over="ignore"):
        h = np.full(k, _U(min(len(words), width)), np.uint64)
        for j in range(min(width, len(words))):
            h = h * _U(0xD6E8FEB86659FD93) + words[j : j + k]
        return mix(h)


# --- connected components ---------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) of an undirected graph with edges (a, b) of longs; the component is its smallest node.

    Alternates the two star contractions: every node hands its larger neighbours, then its
    smaller ones, to the smallest it knows. A node's neighbours are never gathered: minima are
    aggregated with partial sums and joined back, so a hub with most of the edges is spread by
    the skew split. Every round is written to the shared folder; the driver sees two numbers.
    Isolated nodes and self-loops give no row.
    """
    edge = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(most):
        both = edge.union(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edge = stored(
            small.select("a", F.col("m").alias("b"))
            .union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            name,
        )
        now = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = edge.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edge.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def batches(pairs: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    held: list = []
    for x in pairs:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def arrow_rows(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
