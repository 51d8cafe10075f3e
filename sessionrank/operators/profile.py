"""Column profiles: type, counts and a suggested role per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that mark an identifier, and the limits of a categorical number.
ID_NAME = r"(?i)(^|_)(id|sku|user|item|product|category|merchant|brand)(s)?(_id)?($|_)"
FEW_VALUES = 20
MANY_VALUES = 100
LOW_RATIO = 0.05

# Names of time columns.
TIME_NAMES = ["event_time", "timestamp", "ts", "time", "datetime", "event_timestamp", "session_start", "session_time"]
TIME_PARTS = ["time", "date", "ts"]


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    return "number" if isinstance(dtype, T.NumericType) else "other"


def _numbered(frames: Sequence[DataFrame]) -> list[tuple[DataFrame, list[tuple[int, str]]]]:
    """Every frame with the numbers of its columns; they go on from frame to frame."""
    at, out = 0, []
    for df in frames:
        out.append((df, list(enumerate(df.columns, at))))
        at += len(df.columns)
    return out


def _counts(frames: Sequence[DataFrame]) -> DataFrame:
    """One row: a map from column number to (non_null_rows, distinct_values), exact, with one narrow key for all columns of all frames.

    Every value becomes (column, 128 bits of its hash). Equal ones are counted where they lie,
    so a column with few values sends few rows, and no row is copied with all its columns.
    """
    stacks = []
    for df, columns in _numbered(frames):
        values = [(i, F.col(f"`{c}`")) for i, c in columns]
        cells = [F.struct(F.lit(i).alias("i"), F.when(v.isNotNull(), F.xxhash64(v)).alias("a"), F.when(v.isNotNull(), F.xxhash64(F.lit(i), v)).alias("b")) for i, v in values]
        stacks.append(df.select(F.inline(F.array(*cells))))
    counted = reduce(DataFrame.union, stacks).groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    each = counted.groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null_rows"), F.count("a").alias("distinct_values"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("non_null_rows", "distinct_values")))).alias("counts"))


def _sketched(frames: Sequence[DataFrame]) -> DataFrame:
    """The same by one HyperLogLog sketch a column: a single pass, nothing exchanged but the sketches."""
    parts = [df.agg(F.create_map(*[x for i, c in columns for x in (F.lit(i), F.struct(F.count(f"`{c}`").alias("non_null_rows"), F.approx_count_distinct(f"`{c}`").alias("distinct_values")))]).alias("m")) for df, columns in _numbered(frames)]
    entries = F.flatten(F.collect_list(F.map_entries("m")))
    return reduce(DataFrame.union, parts).agg(F.map_from_entries(entries).alias("counts"))


NEAR = 4  # times the limit up to which an estimate calls for an exact count


def _settled(frames: Sequence[DataFrame]) -> DataFrame:
    """Estimates, and exact counts of those columns whose role or note hangs on them."""
    found = {i: tuple(r) for i, r in _sketched(frames).first()["counts"].items()}  # an entry a column
    close, picked = [], []
    for df, columns in _numbered(frames):
        near = [(i, c) for i, c in columns if found[i][1] <= NEAR * MANY_VALUES]
        if near:
            close += [i for i, _ in near]
            picked.append(df.select(*[f"`{c}`" for _, c in near]))
    if picked:
        found |= {close[j]: tuple(r) for j, r in _counts(picked).first()["counts"].items()}
    return frames[0].sparkSession.createDataFrame([(found,)], "counts map<int,struct<non_null_rows:bigint,distinct_values:bigint>>")


def profile(df: DataFrame, table: str, distinct: str = "exact") -> DataFrame:
    """One row per column: type, non-null rows, distinct values, role and the reason for it.

    ``distinct`` is "exact"; "sketch" for estimates in a single pass; or "settled", which
    counts exactly only the columns whose estimate lies near the limits that decide a role.
    """
    return profiles({table: df}, distinct)


def profiles(frames: Mapping[str, DataFrame], distinct: str = "exact") -> DataFrame:
    """The profiles of several tables from one aggregation over all their columns."""
    counts = {"exact": _counts, "sketch": _sketched, "settled": _settled}[distinct](list(frames.values()))
    cells = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.lit(_kind(df.schema[c].dataType)).alias("kind"),
            *[F.coalesce(F.try_element_at("counts", F.lit(i))[n], F.lit(0)).cast("bigint").alias(n) for n in ("non_null_rows", "distinct_values")],
        )
        for name, (df, columns) in zip(frames, _numbered(list(frames.values())))
        for i, c in columns
    ]
    rows = counts.select(F.inline(F.array(*cells)))
    ratio = F.try_divide(F.col("distinct_values"), F.col("non_null_rows"))
    number, few = F.col("kind") == "number", F.col("distinct_values") <= FEW_VALUES
    low = (ratio <= LOW_RATIO) & (F.col("distinct_values") <= MANY_VALUES)
    note = (
        F.when(~number, F.col("kind"))
        .when(F.col("column_name").rlike(ID_NAME), "id-like")
        .when(few, F.format_string("low-cardinality (%d)", "distinct_values"))
        .when(low, F.format_string("low unique ratio (%.3f)", ratio))
        .otherwise("continuous")
    )
    role = F.when((F.col("kind") == "datetime") | (note == "continuous"), "numeric").otherwise("categorical")
    return rows.withColumn("note", note).withColumn("role", role).drop("kind")


def time_column(df: DataFrame) -> str | None:
    """The first time-named column with a value that parses, else the first numeric one with a value."""
    named = [c for c in df.columns if c.lower() in TIME_NAMES or any(p in c.lower() for p in TIME_PARTS)]
    kinds = {f.name: _kind(f.dataType) for f in df.schema}
    wanted = [c for c in named if kinds[c] != "other"] + [c for c in df.columns if kinds[c] == "number" and c not in named]
    if not wanted:
        return None

    def parsed(c: str):
        if kinds[c] in ("number", "datetime"):
            return F.col(c)
        return F.try_to_timestamp(F.col(c).cast("string"))

    counts = df.agg(*[F.count(parsed(c)).alias(c) for c in wanted]).first().asDict()
    return next((c for c in wanted if counts[c] > 0), None)


def multiword_columns(df: DataFrame) -> DataFrame:
    """(column_name, multiword): whether any value of a text column holds white space."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    cells = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.bool_or(F.col(c).rlike(r"\s")), F.lit(False)).alias("multiword")) for c in names]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
