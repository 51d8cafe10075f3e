"""The enriched session table: static attributes and all as-of features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.functions.dates import calendar_parts
from sessionrank.functions.rates import smoothed
from sessionrank.operators import history
from sessionrank.operators.clean import fill_by_type
from sessionrank.operators.history import Latest, Running, as_of_dealt, crowding, meet, timeline
from sessionrank.session import NARROW_ROWS, durable, narrow, output_path
from sessionrank.sources.sinks import to_parquet


def site_rates(prefix: str) -> dict:
    """Smoothed order, cart and favourite rates per click from prefixed totals."""
    click = F.col(f"{prefix}_click")
    parts = {"order": "orders", "cart": "cart", "fav": "fav"}
    return {f"{prefix}_{n}_rate": smoothed(F.col(f"{prefix}_{c}"), click) for n, c in parts.items()}


def ctr(prefix: str) -> dict:
    """Smoothed click-through rate from prefixed totals."""
    return {f"{prefix}_ctr": smoothed(F.col(f"{prefix}_click"), F.col(f"{prefix}_impression"))}


def enrich(
    sessions: DataFrame,
    content: DataFrame,
    users: DataFrame,
    prices: Latest,
    logs: Mapping[str, tuple[DataFrame, list[str], str, Mapping[str, str]]],
    heads: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Sessions with static columns, newest prices and running totals with their rates.

    ``logs`` maps an output prefix to (log, keys, time column, counters). Logs and prices
    with the same keys share one timeline; entries that name the same log share its scan. Key
    sets that contain one another's columns share one exchange of the rows, unless a key is
    crowded: then every key set has a timeline of its own.

    ``heads`` holds what belongs to a session as a whole (its user, term and hour) and
    ``sessions`` then only the rest, met on session_id. Logs keyed by columns of the heads are
    read for the heads, which are fewer and narrower than the rows, and users meet them there; the widest payload, that
    of the items, is found last and is not exchanged again. ``asked`` names a cheaper frame that
    holds the item keys of ``sessions`` at least as often, by which crowded ones are found.
    """
    by_keys: dict[tuple, list] = {("content_id",): [prices]}
    derived, totals = {}, []
    for prefix, (log, keys, ts, counters) in logs.items():
        by_keys.setdefault(tuple(keys), []).append(Running(log, {f"{prefix}_{n}": c for n, c in counters.items()}, ts))
        totals += [f"{prefix}_{n}" for n in counters]
        derived.update(ctr(prefix) if "impression" in counters else site_rates(prefix))

    def names(sources: list) -> list[str]:
        return [c for s in sources for c in (s.columns if isinstance(s, Latest) else s.sums)]

    # key sets by the smallest one that they contain
    homes: dict[tuple, list[tuple]] = {}
    for keys in sorted(by_keys, key=len):
        homes.setdefault(next((h for h in homes if set(h) <= set(keys)), keys), []).append(keys)
    widths = {home: sum(len(names(by_keys[keys])) for keys in held) for home, held in homes.items()}
    todo = sorted(homes, key=widths.__getitem__)

    late = []

    def written(df: DataFrame) -> DataFrame:
        return to_parquet(df, output_path(df.sparkSession, "heads"))

    def found(left: DataFrame, home: tuple, known: DataFrame, counted: DataFrame | None = None) -> DataFrame:
        parts = [(list(keys), by_keys[keys]) for keys in homes[home]]
        logged = {id(s.log): s.log for _, sources in parts for s in sources}
        total, most = crowding([known if counted is None else counted, *logged.values()], home)
        if most <= history.MOST:
            return as_of_dealt(left, home, parts, total=total)
        if counted is not None:  # read once for the timelines' hours and once for the joins
            left = known = durable(left)
        for keys, sources in parts:
            line = durable(timeline(known, keys, sources))
            if line.count() <= NARROW_ROWS:  # few keys: the finished rows meet it where they are
                late.append((keys, line))
            else:
                left = meet(left, line, keys)
        return left

    order, early = list(sessions.columns), heads is not None and "user_id" in heads.columns
    about = [c for c in users.columns if c != "user_id"]
    if heads is None:
        out = known = durable(sessions)
    else:
        order = list(dict.fromkeys(["session_id", "content_id", *heads.columns, *order]))
        own = [home for home in todo if set().union(*homes[home]) <= set(heads.columns)]
        todo = [home for home in todo if home not in own]
        out = known = written(heads)
        for home in own:
            out = found(out, home, known)
        if early:  # not the rows, which are more and by then far wider
            out = out.join(narrow(users), "user_id", "left")
        out = sessions.join(written(out), "session_id")
    for home in todo:
        if heads is None:
            out = found(out, home, known)
        else:
            out = found(out, home, out, out if asked is None else asked)
    for keys, line in late:
        out = meet(out, F.broadcast(line), keys)
    by_width = sorted(by_keys.values(), key=lambda sources: len(names(sources)))
    order += [c for sources in by_width for c in names(sources)]
    out = out.select(*order, *(about if early else [])).join(narrow(content), "content_id", "left")
    if not early:
        out = out.join(narrow(users), "user_id", "left")
    out = out.select(*dict.fromkeys(["user_id", "content_id", *order, *[c for c in content.columns if c != "content_id"], *about]))
    parts = calendar_parts(F.col("ts_hour"))
    out = out.withColumns({
        **derived,
        **{c: F.col(c).cast("double") for c in totals},
        "hour_of_day": parts["hour_of_day"],
        "day_of_week": parts["day_of_week"],
    })
    return fill_by_type(out)
