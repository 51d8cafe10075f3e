"""Exact splits by time position, as filters: no row is sorted or moved to be split.

One pass counts the rows of every hour, with a bucket for rows without a time; there are as many
buckets as the calendar has hours. A position lies in one of them, and only the rows of that hour
are looked at again, to find the one row at the position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrank.operators.ordering import SMALL_ROWS, kept, key_at, literal

# A total order over session rows, so that a position names one row.
ORDER = ("ts_hour", "session_id", "content_id")


def _filled(df: DataFrame, order: Sequence[str]) -> dict[str, Column]:
    """The order as columns without nulls, nulls first: for each a flag of presence, then the value or a constant."""
    out = {}
    for c in order:
        kind = df.schema[c].dataType
        blank = F.lit("1900-01-01" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "" if isinstance(kind, T.StringType) else "0").cast(kind)
        out[f"_has_{c}"], out[f"_val_{c}"] = F.col(c).isNotNull().cast("int"), F.coalesce(F.col(c), blank)
    return out


def _side(df: DataFrame, order: Sequence[str], key: tuple, after: bool) -> Column:
    """Rows whose order key is above ``key``, or at most it. A null-free first column lets its bound reach the scan."""
    filled = _filled(df, order)
    kinds = [k for c in order for k in (T.IntegerType(), df.schema[c].dataType)]
    ours = F.struct(*[c.alias(n) for n, c in filled.items()])
    cut = F.struct(*[literal(v, k).alias(n) for n, v, k in zip(filled, key, kinds)])
    first, bound = F.col(order[0]), literal(key[1], kinds[1])
    if after:
        return (first >= bound) & (ours > cut) if key[0] else ours > cut
    return (first.isNull() | (first <= bound)) & (ours <= cut) if key[0] else first.isNull() & (ours <= cut)


def _hours(df: DataFrame, ts: str) -> list[tuple]:
    """(hour, rows, least time, greatest time) of every hour in order, rows without a time first; at most one row an hour of the calendar."""
    hour = F.date_trunc("hour", F.col(ts)).cast(df.schema[ts].dataType).alias("hour")
    rows = df.select(ts, hour).groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("low"), F.max(ts).alias("high")).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0]))


def _bucket(hours: list[tuple], position: int) -> tuple[tuple, int]:
    """The hour that holds a position, and the position among its rows."""
    for h in hours:
        if position < h[1]:
            return h, position
        position -= h[1]
    raise ValueError("position beyond the last row")


def _in_hour(df: DataFrame, ts: str, hour: tuple) -> DataFrame:
    """The rows of an hour; the bounds of its times reach the scan."""
    if hour[0] is None:
        return df.where(F.col(ts).isNull())
    kind = df.schema[ts].dataType
    return df.where((F.col(ts) >= literal(hour[2], kind)) & (F.col(ts) <= literal(hour[3], kind)))


def _keys_at(df: DataFrame, order: Sequence[str], positions: Sequence[int], hours: list[tuple], small_rows: int) -> list[tuple]:
    """The order keys of the rows at some positions."""
    filled, found = _filled(df, order), []
    for position in positions:
        hour, inside = _bucket(hours, position)
        rows = _in_hour(df, order[0], hour).select(*[c.alias(n) for n, c in filled.items()])
        if hour[1] <= small_rows:
            found.append(key_at(rows, list(filled), inside, hour[1], small_rows))
        else:
            with kept(rows) as keys:
                found.append(key_at(keys, list(filled), inside, hour[1], small_rows))
    return found


def time_split(df: DataFrame, val_frac: float = 0.15, order: Sequence[str] = ORDER, small_rows: int = SMALL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(first int(n * (1 - val_frac)) rows by time, the rest); rows without a time come first."""
    hours = _hours(df, order[0])
    size = int(sum(h[1] for h in hours) * (1 - val_frac))
    if size == 0:
        return df.where(F.lit(False)), df
    (cut,) = _keys_at(df, order, [size - 1], hours, small_rows)
    return df.where(_side(df, order, cut, False)), df.where(_side(df, order, cut, True))


def three_way(df: DataFrame, val_frac: float = 0.15, test_frac: float = 0.05, order: Sequence[str] = ORDER, small_rows: int = SMALL_ROWS) -> dict[str, DataFrame]:
    """First ``test_frac`` of the rows test, last ``val_frac`` validation, the middle train; rows without a time come first."""
    hours = _hours(df, order[0])
    n = sum(h[1] for h in hours)
    test_end, val_start = int(n * test_frac), int(n * (1 - val_frac))
    if not 0 < test_end < val_start:
        raise ValueError(f"{n} rows are too few for a three-way split")
    low, high = _keys_at(df, order, [test_end - 1, val_start - 1], hours, small_rows)
    return {
        "test": df.where(_side(df, order, low, False)),
        "train": df.where(_side(df, order, low, True) & _side(df, order, high, False)),
        "val": df.where(_side(df, order, high, True)),
    }


def cutoffs(df: DataFrame, ts: str = "ts_hour", val_frac: float = 0.15, test_frac: float = 0.05, small_rows: int = SMALL_ROWS) -> tuple:
    """The times at the test end and validation start positions; only the time column is read, rows without a time are left out of the count.

    Where all times of the hour are one, as in hourly tables, the count alone answers.
    """
    hours = [h for h in _hours(df, ts) if h[0] is not None]
    n, found = sum(h[1] for h in hours), []
    for f in (test_frac, 1 - val_frac):
        hour, inside = _bucket(hours, max(0, min(n - 1, int(n * f))))
        found.append(hour[2] if hour[2] == hour[3] else key_at(_in_hour(df.select(ts), ts, hour), [ts], inside, hour[1], small_rows)[0])
    return tuple(found)


def by_cutoffs(df: DataFrame, low, high, ts: str = "ts_hour") -> dict[str, DataFrame]:
    """Whole hours: test up to ``low``, validation from ``high``, train strictly between. Rows without a time come first, in test."""
    kind = df.schema[ts].dataType
    a, b = literal(low, kind), literal(high, kind)
    t = F.col(ts)
    return {"test": df.where(t.isNull() | (t <= a)), "train": df.where((t > a) & (t < b)), "val": df.where(t >= b)}
