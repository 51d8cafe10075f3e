"""Running totals, session statistics, splits, codes, sorts and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionrank.operators import aggregates, encode, fitted, history, splits
from sessionrank.plans.registry import query, views
from sessionrank.sources import fixtures as fx
from sessionrank.sources.tables import table


@query("cumulative_counters", f"""{views("content_sitewide_log")},
    h as (select content_id, date_trunc('hour', date) as ts_hour, sum(click) as click, sum(orders) as orders from content_sitewide_log group by all)
    select content_id, ts_hour, sum(click) over w as click, cast(sum(orders) over w as bigint) as orders from h
    window w as (partition by content_id order by ts_hour)""")
def cumulative_counters(spark, sf):
    return history.cumulative(fx.content_sitewide_log(spark, sf), ["content_id"], {"click": "click", "orders": "orders"}, "date")


@query("cumulative_click_events", f"""{views("user_content_log")}
    select user_id, content_id, ts_hour, cast(max(n) as bigint) as click_hours from (select user_id, content_id, ts_hour,
    count(*) filter (total_click > 0) over (partition by user_id, content_id order by ts_hour) as n from user_content_log) group by 1, 2, 3""")
def cumulative_click_events(spark, sf):
    click = F.when(F.col("total_click") > 0, 1).otherwise(0)
    return history.cumulative(fx.user_content_log(spark, sf), ["user_id", "content_id"], {"click_hours": click})


SESSION_PRICED = """p as (select content_id, floor(max(selling_price)) as selling_price from content_price group by 1),
    s as (select session_id, content_id, case when p_order = 0 then null else selling_price end as selling_price from sessions left join p using (content_id))"""


def _session_priced(spark, sf):
    prices = fx.content_price(spark, sf).groupBy("content_id").agg(F.floor(F.max("selling_price")).cast("double").alias("selling_price"))
    rows = fx.sessions(spark, sf).join(prices, "content_id", "left")
    return rows.withColumn("selling_price", F.when(F.col("p_order") != 0, F.col("selling_price")))


@query("session_price_z", f"""{views("sessions", "content_price")}, {SESSION_PRICED},
    w as (select *, avg(selling_price) over w as m, coalesce(stddev_samp(selling_price) over w, 0) as sd from s window w as (partition by session_id))
    select session_id, content_id, m as sess_price_mean, round(sd, 6) as sess_price_std,
           round(case when sd > 0 then (coalesce(selling_price, 0) - m) / sd else 0 end, 6) as sess_price_z from w""")
def session_price_z(spark, sf):
    return fitted.session_price(_session_priced(spark, sf)).select(
        "session_id", "content_id", "sess_price_mean",
        F.round("sess_price_std", 6).alias("sess_price_std"), F.round("sess_price_z", 6).alias("sess_price_z"),
    )


@query("session_size", f"{views('sessions')} select session_id, content_id, count(*) over (partition by session_id) as sess_n_items from sessions")
def session_size(spark, sf):
    rows = fx.sessions(spark, sf).select("session_id", "content_id")
    return rows.join(rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("sess_n_items")), "session_id")


@query("latest_per_key", f"""{views("content_price")} select content_id, update_date, selling_price, original_price from
    (select *, row_number() over (partition by content_id order by update_date desc, selling_price desc, original_price desc) as rn from content_price) where rn = 1""")
def latest_per_key(spark, sf):
    return aggregates.latest(fx.content_price(spark, sf), ["content_id"], ["update_date", "selling_price", "original_price"], ["selling_price", "original_price"])


NUMBERED = f"""{views("sessions")}, r as (select session_id, content_id, ts_hour, row_number() over (order by ts_hour, session_id, content_id) as rn,
    count(*) over () as n from sessions)"""


@query("time_split_rank", f"{NUMBERED} select session_id, content_id, ts_hour, case when rn <= floor(n * (1 - 0.15::double)) then 'train' else 'val' end as part from r")
def time_split_rank(spark, sf):
    train, val = splits.time_split(fx.sessions(spark, sf).select("session_id", "content_id", "ts_hour"))
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


def _labelled(parts):
    frames = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("time_split_three_way", f"""{NUMBERED} select session_id, content_id, ts_hour, case when rn <= floor(n * 0.05::double) then 'test'
    when rn > floor(n * (1 - 0.15::double)) then 'val' else 'train' end as part from r""")
def time_split_three_way(spark, sf):
    return _labelled(splits.three_way(fx.sessions(spark, sf).select("session_id", "content_id", "ts_hour")))


@query("time_cutoffs", f"""{NUMBERED}, c as (select max(ts_hour) filter (rn = floor(n * 0.05::double) + 1) as low, max(ts_hour) filter (rn = floor(n * (1 - 0.15::double)) + 1) as high from r)
    select session_id, content_id, ts_hour, case when ts_hour <= low then 'test' when ts_hour >= high then 'val' else 'train' end as part from r, c""")
def time_cutoffs(spark, sf):
    rows = fx.sessions(spark, sf).select("session_id", "content_id", "ts_hour")
    return _labelled(splits.by_cutoffs(rows, *splits.cutoffs(rows)))


@query("group_codes", f"""{views("sessions")} select session_id, dense_rank() over (order by session_id) - 1 as group_id, n as group_size
    from (select session_id, count(*) as n from sessions group by 1)""")
def group_codes(spark, sf):
    return encode.group_codes(fx.sessions(spark, sf), "session_id")


@query("dense_id_map", f"""{views("sessions")}, t as (select distinct user_id from sessions where ts_hour < timestamp '1999-01-01'),
    m as (select user_id, row_number() over (order by user_id) as code from t)
    select s.session_id, s.content_id, s.user_id, coalesce(m.code, 0) as user_id_code from sessions s left join m using (user_id)""")
def dense_id_map(spark, sf):
    rows = fx.sessions(spark, sf)
    early = rows.where("ts_hour < timestamp_ntz '1999-01-01 00:00:00'")
    codes = encode.dense_codes([early], "user_id")
    return encode.apply_codes(rows.select("session_id", "content_id", "user_id"), codes, "user_id")


# ---- sorts and limits

@query("sort_multi", f"{views('sessions')} select session_id, content_id, p_order from sessions")
def sort_multi(spark, sf):
    return fx.sessions(spark, sf).select("session_id", "content_id", "p_order").orderBy(F.asc("session_id"), F.desc("p_order"), F.asc("content_id"))


@query("limit_head", f"{views('sessions')} select session_id, content_id, ts_hour from sessions order by ts_hour, session_id, content_id limit 100")
def limit_head(spark, sf):
    return fx.sessions(spark, sf).select("session_id", "content_id", "ts_hour").orderBy("ts_hour", "session_id", "content_id").limit(100)


@query("top_days", """with d as (select date_trunc('day', ts)::date as day, count(*) as n from events group by 1)
    (select day, n, 'first' as side from d order by day limit 10) union all (select day, n, 'last' as side from d order by day desc limit 10)""")
def top_days(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    first = days.orderBy("day").limit(10).withColumn("side", F.lit("first"))
    return first.unionByName(days.orderBy(F.desc("day")).limit(10).withColumn("side", F.lit("last")))


# ---- set operations

def _halves(spark, sf):
    rows = fx.sessions(spark, sf)
    cut = "timestamp_ntz '1999-01-01 00:00:00'"
    return rows.where(f"ts_hour < {cut}"), rows.where(f"ts_hour >= {cut}")


@query("union_train_test", f"""{views("sessions")} select session_id, content_id, ordered, 'train' as part from sessions where ts_hour < timestamp '1999-01-01'
    union all select session_id, content_id, null, 'test' from sessions where ts_hour >= timestamp '1999-01-01'""")
def union_train_test(spark, sf):
    train, test = _halves(spark, sf)
    labelled = train.select("session_id", "content_id", "ordered", F.lit("train").alias("part"))
    return labelled.unionByName(test.select("session_id", "content_id", F.lit("test").alias("part")), allowMissingColumns=True)


@query("union_distinct_ids", f"""{views("sessions")} select user_id from sessions where ts_hour < timestamp '1999-01-01' union select user_id from sessions where ts_hour >= timestamp '1999-01-01'""")
def union_distinct_ids(spark, sf):
    train, test = _halves(spark, sf)
    return train.select("user_id").union(test.select("user_id")).distinct()


@query("distinct_pairs", f"{views('sessions')} select distinct user_id, ts_hour from sessions")
def distinct_pairs(spark, sf):
    return fx.sessions(spark, sf).select("user_id", "ts_hour").distinct()
