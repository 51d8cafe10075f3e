"""Joins against the past: as-of snapshots, running counters, strictly-past multiplicity.

All times are floored to the hour first, so a key has at most one timeline row per
hour of the calendar. The timeline (logs aggregated per key and hour, plus the hours
at which the key is asked for) is therefore bounded per key however hot the key is;
only the timeline is sorted. The wide left rows are never sorted per key: they meet
the resolved timeline in an equi-join on (key, hour), which adaptive execution can
split when one key dominates.

Where no key has more than ``MOST`` rows (``crowding`` looks), one exchange by the key does for
all logs and key sets that share it: left rows and log rows are dealt together, and nothing has
to travel back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionrank.functions.dates import floor_hour


MOST = 200_000  # rows of a key up to which its rows are dealt to one task, unaggregated
TASK_ROWS = 1_000_000  # rows that one task sorts, about
BUCKETS = 1 << 15  # keys are counted by hash in so many buckets


@dataclass(frozen=True)
class Running:
    """Counters of a log, read as totals up to the asked hour. ``sums`` maps output to input."""

    log: DataFrame
    sums: Mapping[str, str | Column]
    ts: str = "ts_hour"


@dataclass(frozen=True)
class Latest:
    """A snapshot log, read as its newest row up to the asked hour (ties: largest payload)."""

    log: DataFrame
    columns: Sequence[str]
    ts: str = "ts_hour"


def hourly_sums(log: DataFrame, keys: Sequence[str], sums: Mapping[str, str | Column], ts: str = "ts_hour") -> DataFrame:
    """Counters per (keys, hour); rows without a full key are left out."""
    rows = log.select(*keys, floor_hour(ts).alias("ts_hour"), *[_col(c).alias(n) for n, c in sums.items()])
    return rows.dropna(subset=[*keys, "ts_hour"]).groupBy(*keys, "ts_hour").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums]
    )


def cumulative(log: DataFrame, keys: Sequence[str], sums: Mapping[str, str | Column], ts: str = "ts_hour") -> DataFrame:
    """Running totals per key over its hours."""
    frame = _past(keys, "ts_hour")
    hourly = hourly_sums(log, keys, sums, ts)
    return hourly.select(*keys, "ts_hour", *[F.sum(n).over(frame).alias(n) for n in sums])


def as_of(
    left: DataFrame,
    keys: Sequence[str],
    sources: Sequence[Running | Latest],
    ts: str = "ts_hour",
    strict: bool = False,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Left rows with every source's state at or before (``strict``: before) the row's hour.

    A key without history gets nulls. All sources of one key share one timeline: one
    aggregation, one sort and one join, however many sources there are; sources with the same
    log (the same frame) and time also share one scan of it. ``asked`` names a cheaper frame with the same keys and times, for a left side that is itself a long plan.
    """
    return meet(left, timeline(left if asked is None else asked, keys, sources, ts, strict), keys, ts)


def timeline(asked: DataFrame, keys: Sequence[str], sources: Sequence[Running | Latest], ts: str = "ts_hour", strict: bool = False) -> DataFrame:
    """What ``as_of`` finds: a row per asked (keys, hour) with every source's state."""
    wanted = asked.select(*keys, floor_hour(ts).alias("_hour"), F.lit(1).alias("_asked"))
    stacked = wanted.dropna(subset=[*keys, "_hour"])
    merges, reads = [F.max("_asked").alias("_asked")], []
    frame = _past(keys, "_hour", strict)
    # sources that share a log and its time are read from one pass over it
    shared: dict[tuple[int, str], list[tuple[int, Running | Latest]]] = {}
    for i, source in enumerate(sources):
        shared.setdefault((id(source.log), source.ts), []).append((i, source))
    for g, ((_, time), group) in enumerate(shared.items()):
        columns, seen = [], f"_n{g}"
        if any(isinstance(source, Running) for _, source in group):
            columns.append(F.lit(1).alias(seen))
            merges.append(F.max(seen).alias(seen))
        for i, source in group:
            if isinstance(source, Latest):
                slot = f"_s{i}"
                columns.append(F.struct(*source.columns).alias(slot))
                merges.append(F.max(slot).alias(slot))
                newest = F.last(slot, ignorenulls=True).over(frame).alias(slot)
                reads.append((i, [newest], [F.col(f"{slot}.{c}").alias(c) for c in source.columns]))
            else:
                slots = {f"_c{i}_{j}": c for j, c in enumerate(source.sums.values())}
                columns += [_col(c).alias(s) for s, c in slots.items()]
                merges.extend(F.sum(s).alias(s) for s in slots)
                known = F.max(seen).over(frame)
                totals = [F.when(known == 1, F.coalesce(F.sum(s).over(frame), F.lit(0))).alias(s) for s in slots]
                reads.append((i, totals, [F.col(s).alias(n) for s, n in zip(slots, source.sums)]))
        rows = group[0][1].log.select(*keys, floor_hour(time).alias("_hour"), *columns)
        stacked = stacked.unionByName(rows.dropna(subset=[*keys, "_hour"]), allowMissingColumns=True)
    reads.sort(key=lambda read: read[0])
    return (
        stacked.groupBy(*keys, "_hour").agg(*merges)
        .select(*keys, "_hour", "_asked", *[c for _, totals, _ in reads for c in totals])
        .where("_asked = 1")
        .select(*keys, "_hour", *[c for *_, outputs in reads for c in outputs])
    )


def crowding(frames: Sequence[DataFrame], keys: Sequence[str]) -> tuple[int, int]:
    """(rows of all frames together, a number that no key, the null one included, exceeds).

    Rows are counted by hash of the key, so that only counters travel. A bucket counts all its
    keys: the bound is sure, but a large one may come from many small keys.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    hashed = [df.select(*keys).select(bucket) for df in frames]
    counts = reduce(DataFrame.union, hashed).groupBy("_bucket").count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    return total or 0, most or 0


def as_of_dealt(left: DataFrame, deal: Sequence[str], parts: Sequence[tuple[Sequence[str], Sequence[Running | Latest]]], ts: str = "ts_hour", total: int = 0) -> DataFrame:
    """``as_of`` for several (keys, sources), by one exchange on the columns ``deal`` that all the key sets contain.

    Left rows travel whole beside the log rows and meet them in windows, so all rows of a value of
    ``deal`` come to one task: for keys of at most ``MOST`` rows. With the ``total`` of rows there
    are as many tasks as let each sort its rows in memory.
    """
    known = list(dict.fromkeys(k for keys, _ in parts for k in keys))
    rest = [c for c in left.columns if c not in known]
    stacked = left.select(*known, floor_hour(ts).alias("_hour"), F.struct(*rest).alias("_row"))
    reads, at = [], 0
    for keys, sources in parts:
        frame = Window.partitionBy(*keys).orderBy("_hour").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        # sources that share a log and its time are read from one pass over it
        shared: dict[tuple[int, str], list[Running | Latest]] = {}
        for source in sources:
            shared.setdefault((id(source.log), source.ts), []).append(source)
        for (_, time), group in shared.items():
            slot, fields = f"_g{at}", []
            there = F.col(slot).isNotNull()
            for i, source in enumerate(group):
                if isinstance(source, Latest):
                    fields.append(F.struct(*source.columns).alias(f"s{i}"))
                    newest = F.max(F.when(there, F.struct("_hour", f"{slot}.s{i}"))).over(frame)
                    reads.append((f"_r{at}_{i}", newest, [(f"s{i}.{c}", c) for c in source.columns]))
                else:
                    for j, (name, column) in enumerate(source.sums.items()):
                        fields.append(_col(column).alias(f"c{i}_{j}"))
                        summed = F.coalesce(F.sum(f"{slot}.c{i}_{j}").over(frame), F.lit(0))
                        reads.append((name, F.when(F.max(there).over(frame), summed), None))
            rows = group[0].log.select(*keys, floor_hour(time).alias("_hour"), F.struct(*fields).alias(slot))
            stacked = stacked.unionByName(rows.dropna(subset=[*keys, "_hour"]), allowMissingColumns=True)
            at += 1
    tasks, least = total // TASK_ROWS + 1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stacked.repartition(tasks, *deal) if tasks > least else stacked.repartition(*deal)
    resolved = dealt.select(*known, "_row", *[column.alias(name) for name, column, _ in reads]).where("_row is not null")
    outputs = []
    for name, _, fields in reads:
        outputs += [F.col(name)] if fields is None else [F.col(f"{name}.{path}").alias(c) for path, c in fields]
    return resolved.select(*[F.col(c if c in known else f"_row.{c}") for c in left.columns], *outputs)


def past_multiplicity(log: DataFrame, asked: DataFrame, keys: Sequence[str], log_ts: str = "ts_hour", ts: str = "ts_hour") -> DataFrame:
    """Log rows with ``later_hours``: how many distinct later asked hours their key has.

    Stands for the strictly-past range join, in which a log row appears once per later
    asked hour, without writing the repeats. Rows with no later hour are dropped, as there.
    """
    hours = asked.select(*keys, floor_hour(ts).alias("_hour"), F.lit(1).alias("_asked"))
    logged = log.select(*keys, floor_hour(log_ts).alias("_hour"), F.lit(0).alias("_asked"))
    later = Window.partitionBy(*keys).orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        hours.unionByName(logged).dropna(subset=[*keys, "_hour"])
        .groupBy(*keys, "_hour").agg(F.max("_asked").alias("_asked"))
        .select(*keys, "_hour", F.coalesce(F.sum("_asked").over(later), F.lit(0)).cast("bigint").alias("later_hours"))
        .where("later_hours > 0")
    )
    return meet(log, counts, keys, log_ts, how="inner")


def past_repeats(log: DataFrame, asked: DataFrame, keys: Sequence[str], log_ts: str = "ts_hour", ts: str = "ts_hour") -> DataFrame:
    """The strictly-past range join written out, for small inputs and for checking."""
    hours = asked.select(*keys, floor_hour(ts).alias("_hour")).distinct()
    return log.join(hours, list(keys)).where(F.col(log_ts) < F.col("_hour")).drop("_hour")


def past_sums(log: DataFrame, asked: DataFrame, keys: Sequence[str], sums: Sequence[str], ts: str = "ts_hour") -> DataFrame:
    """Per key, sums over the strictly-past range join, with its row count as ``rows``.

    Only the log aggregated per (key, hour) takes part.
    """
    frame = Window.partitionBy(*keys).orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hours = asked.select(*keys, floor_hour(ts).alias("_hour"), F.lit(1).alias("_asked"))
    logged = log.select(*keys, floor_hour(ts).alias("_hour"), F.lit(1).alias("_rows"), *sums)
    per_hour = (
        hours.unionByName(logged, allowMissingColumns=True).dropna(subset=[*keys, "_hour"])
        .groupBy(*keys, "_hour")
        .agg(F.max("_asked").alias("_asked"), F.sum("_rows").alias("_rows"), *[F.sum(c).alias(c) for c in sums])
        .withColumn("_k", F.coalesce(F.sum("_asked").over(frame), F.lit(0)))
        .where("_k > 0 and _rows > 0")
    )
    return per_hour.groupBy(*keys).agg(
        F.sum(F.col("_rows") * F.col("_k")).cast("bigint").alias("rows"),
        *[F.coalesce(F.sum(F.col(c) * F.col("_k")), F.lit(0)).alias(c) for c in sums],
    )


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _past(keys: Sequence[str], hour: str, strict: bool = False):
    return Window.partitionBy(*keys).orderBy(hour).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)


def meet(left: DataFrame, resolved: DataFrame, keys: Sequence[str], ts: str = "ts_hour", how: str = "left") -> DataFrame:
    """Left rows with the row of a timeline at their own keys and hour."""
    right = resolved.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in resolved.columns])
    match = floor_hour(left[ts]) == right["_hour"]
    for k in keys:
        match = match & (left[k] == right[f"_{k}"])
    return left.join(right, match, how).drop("_hour", *[f"_{k}" for k in keys])
