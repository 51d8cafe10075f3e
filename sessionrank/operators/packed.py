"""Sessions packed into one row each, for kernels that pass over whole sessions again and again.

Packing costs one exchange; afterwards every pass reads the packed table and moves nothing. Only
sessions of bounded size are packed. Larger ones stay as rows, for the range-partitioned operators.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrank.operators.ordering import split_hot
from sessionrank.session import durable

PACKED_ROWS = 50_000


def pack(df: DataFrame, columns: Sequence[str], session: str = "session_id", item: str = "content_id", hot_rows: int = PACKED_ROWS, where: Column | None = None, written: bool = True) -> tuple[DataFrame | None, DataFrame | None]:
    """(sessions as arrays of their columns in item order, rows of the sessions that are too large); absent parts are None.

    ``where`` is a condition on a session, written over aggregates of its rows; others are left
    out. Both are checkpointed, so that later passes read them and nothing else, unless a single pass follows.
    """
    cold, hot = split_hot(df.select(session, item, *columns), [session], hot_rows)
    chosen = F.lit(True) if where is None else where
    if cold is not None:
        rows = F.array_sort(F.collect_list(F.struct(item, *columns)))
        listed = cold.groupBy(session).agg(rows.alias("_rows"), chosen.alias("_chosen")).where("_chosen")
        cold = listed.select(session, *[F.col(f"_rows.{c}").alias(c) for c in columns])
    if hot is not None and where is not None:
        wanted = hot.groupBy(session).agg(chosen.alias("_chosen")).where("_chosen").select(session)
        hot = hot.join(wanted, session, "left_semi")
    return tuple(None if part is None else durable(part) if written else part for part in (cold, hot))


def flat(column: pa.Array) -> np.ndarray:
    """All values of a list column, one session after another, as doubles; null is NaN."""
    return np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def bounds(column: pa.Array) -> np.ndarray:
    """Where every session begins among the values, and where the last one ends."""
    at = np.asarray(column.offsets)
    return at - at[0]


def coded(values: np.ndarray) -> bytes:
    """Doubles in a byte each where a block has few of them, after how many there are and their table; eight bytes each where not."""
    table, at = np.unique(values, return_inverse=True)
    if not 0 < len(table) < 256:
        return bytes(8) + values.tobytes()
    return len(table).to_bytes(8, "little") + table.tobytes() + at.astype(np.uint8).tobytes()


def uncoded(held: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(held[:8].to_pybytes(), "little")
    if n == 0:
        return np.frombuffer(held, np.float64, offset=8)
    return np.frombuffer(held, np.float64, n, 8).take(np.frombuffer(held, np.uint8, offset=8 + 8 * n))
