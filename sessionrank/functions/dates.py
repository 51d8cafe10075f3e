"""Calendar expressions. Hours are time-zone free."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_hour(c: Column | str, grain: str = "hour") -> Column:
    return F.date_trunc(grain, F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def parse_hour(c: Column | str) -> Column:
    """Text to hour; text that is no time becomes null."""
    return floor_hour(F.try_to_timestamp(F.col(c) if isinstance(c, str) else c))


def strip_zone(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "hour_of_day": F.hour(ts).cast("bigint"),
        "day_of_week": F.weekday(ts).cast("bigint"),
        "iso_weekday": (F.weekday(ts) + 1).cast("bigint"),
        "day_of_month": F.dayofmonth(ts).cast("bigint"),
    }


def is_weekend(ts: Column) -> Column:
    """ISO weekday 5 and up, so Friday counts too."""
    return (F.weekday(ts) + 1) >= 5


def time_period(ts: Column) -> Column:
    """Closed hour ranges, first match wins."""
    h = F.hour(ts)
    return (
        F.when(h.between(6, 12), "morning")
        .when(h.between(12, 18), "afternoon")
        .when(h.between(18, 23), "evening")
        .otherwise("night")
    )


def whole_days_between(start: Column, end: Column) -> Column:
    """Complete 24-hour periods from start to end (floor, so negative spans round down)."""
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return F.floor(seconds / 86400).cast("bigint")


def age_from_birth_year(year: Column, birth_year: Column, default: int = -1) -> Column:
    return F.coalesce(year.cast("bigint") - birth_year.cast("bigint"), F.lit(default).cast("bigint"))
