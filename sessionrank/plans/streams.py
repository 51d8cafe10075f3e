"""The two hourly aggregations as file streams over the events table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sessionrank.plans.registry import query
from sessionrank.sources.tables import table
from sessionrank.streaming import hourly


def _events(spark, sf):
    return hourly.file_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events"))


@query("stream_hourly_counts", "select date_trunc('hour', ts) as ts_hour, count(*) as n from events group by 1")
def stream_hourly_counts(spark, sf):
    return hourly.run_available(_events(spark, sf), "hourly_counts", "ts", [], {"n": F.count(F.lit(1))})


@query("stream_hourly_counters", """select user_id, date_trunc('hour', ts) as ts_hour, count(*) filter (event_type = 'click') as clicks,
    count(*) filter (event_type = 'purchase') as orders from events group by 1, 2""")
def stream_hourly_counters(spark, sf):
    kind = F.col("event_type")
    aggs = {"clicks": F.count_if(kind == "click"), "orders": F.count_if(kind == "purchase")}
    return hourly.run_available(_events(spark, sf), "hourly_counters", "ts", ["user_id"], aggs)


@query("stream_window_counts", """select event_type, date_trunc('hour', ts) as ts_hour, count(*) as n, count(*) filter (user_id % 2 = 0) as n_even from events group by 1, 2""")
def stream_window_counts(spark, sf):
    """The same by event-time state; the files hold no row later than the watermark allows, so that none is left out."""
    aggs = {"n": F.count(F.lit(1)), "n_even": F.count_if(F.col("user_id") % 2 == 0)}
    counted, _ = hourly.run_windows(_events(spark, sf), "window_counts", "ts", ["event_type"], aggs, timedelta(days=1))
    return counted
