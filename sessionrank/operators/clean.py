"""Projection, typing and null handling driven by the schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrank.functions.hashing import md5_bucket
from sessionrank.functions.rates import finite_or, num
from sessionrank.operators.ordering import exact_quantile

# Columns that are keys, labels or times, never model inputs.
NOT_FEATURES = {"session_id", "content_id", "user_id", "search_term", "ts_hour", "ordered", "clicked", "added_to_cart", "added_to_fav"}
TIME_WORDS = ("time", "date", "timestamp", "ts_")


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def project(df: DataFrame, keep: Sequence[str], optional: Iterable[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Wanted columns plus those optional ones that exist, renamed."""
    names = [*keep, *[c for c in optional if c in df.columns]]
    return df.select(*names).withColumnsRenamed(dict(rename or {}))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: num(c) for c in columns})


def fill_by_type(df: DataFrame, number: float = 0, text: str = "UNKNOWN") -> DataFrame:
    """Numeric nulls to a number, text nulls to a word; other types stay."""
    return df.na.fill(number).na.fill(text)


def fill_defaults(df: DataFrame, defaults: Mapping[str, object], median_of: Sequence[str] = ()) -> DataFrame:
    """Per-column defaults; ``median_of`` columns get their exact median."""
    medians = {c: exact_quantile(df, c, 0.5) for c in median_of}
    return df.na.fill({**defaults, **{c: m for c, m in medians.items() if m is not None}})


def zero_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or(F.col(c)) for c in columns})


def fill_sentinel(df: DataFrame, value: float = -999) -> DataFrame:
    return df.na.fill(value)


def replace_with_mean(df: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """Drop an old column, take it from a fresh table, unmatched rows get the mean."""
    joined = df.drop(column).join(fresh.select(key, column), key, "left")
    mean = joined.select(F.avg(column)).scalar()
    return joined.withColumn(column, F.coalesce(F.col(column), mean))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent non-null value of each column, smallest on ties."""
    found = {}
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), F.asc(c)).limit(1).collect()
        if top:
            found[c] = top[0][0]
    return found


def impute(fit_on: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Median and mode of the training rows into the nulls of any rows."""
    values = {c: exact_quantile(fit_on, c, 0.5) for c in numeric}
    values.update(modes(fit_on, categorical))
    return df.na.fill({c: v for c, v in values.items() if v is not None})


def flag_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_missing`` flags, then zero or "missing" in the gaps."""
    flagged = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})
    text = set(string_names(df))
    return flagged.na.fill({c: "missing" if c in text else 0 for c in columns})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; an aggregate, so no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [c for c in order if c not in keys]
    first = F.min(F.struct(*ranked, *[c for c in rest if c not in ranked])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def features(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES, strict: bool = False) -> DataFrame:
    """Model columns: all but the excluded; ``strict`` also drops times and time-named columns."""
    drop = set(exclude)
    fields = [f for f in df.schema if f.name not in drop]
    if strict:
        times = (T.TimestampType, T.TimestampNTZType, T.DateType)
        fields = [f for f in fields if not isinstance(f.dataType, times) and not any(w in f.name.lower() for w in TIME_WORDS)]
    return df.select(*[f.name for f in fields])


def categoricals(df: DataFrame, allowed: Iterable[str] | None = None) -> list[str]:
    """Text columns (of a whitelist when given); without one, every non-numeric column."""
    if allowed is not None:
        wanted = set(allowed)
        return [c for c in string_names(df) if c in wanted]
    numeric = set(numeric_names(df))
    return [c for c in df.columns if c not in numeric]


def per_head(df: DataFrame, ordered_excludes: Sequence[str]) -> dict[str, DataFrame]:
    """Inputs of the two heads: the ordered head does without some price features."""
    return {"ordered": df.drop(*ordered_excludes), "clicked": df}


def whole_sessions(df: DataFrame, rows: int, session: str = "session_id", per: int = 50) -> DataFrame:
    """All rows of the first max(1, rows // per) sessions."""
    chosen = df.select(session).distinct().orderBy(session).limit(max(1, rows // per))
    return df.join(chosen, session, "left_semi")


def hash_bucket_split(df: DataFrame, keys: Sequence[str], percent: int, seed: int = 42):
    """Repeatable split: (rows in the first ``percent`` of 100 hash buckets, the rest).

    Buckets come from the MD5 of seed and keys, so every engine and every run agrees; they
    are independent of the label, so each label is split in the same proportion.
    """
    bucket = md5_bucket(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 100)
    return df.where(bucket < percent), df.where(bucket >= percent)


def presence_flags(df: DataFrame, flags: Sequence[str], text: Mapping[str, str], counts: Mapping[str, float]) -> DataFrame:
    """is-not-null flags, cleaned text copies and filled counts."""
    return df.withColumns({
        **{f"has_{c}": F.col(c).isNotNull() for c in flags},
        **{out: F.coalesce(F.col(c), F.lit("UNKNOWN")) for c, out in text.items()},
        **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in counts.items()},
    })
