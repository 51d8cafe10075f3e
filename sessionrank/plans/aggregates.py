"""Grouped statistics and profiles on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.functions.rates import ratio_or
from sessionrank.operators import aggregates, fitted, history, profile
from sessionrank.plans.registry import query, views
from sessionrank.sources import fixtures as fx
from sessionrank.sources.tables import table


@query("agg_hourly_counters", f"""{views("event_sitewide_log")} select user_id, date_trunc('hour', ts_hour) as ts_hour, cast(sum(click) as bigint) as click,
    cast(sum(orders) as bigint) as orders from event_sitewide_log group by all""")
def agg_hourly_counters(spark, sf):
    return history.hourly_sums(fx.event_sitewide_log(spark, sf), ["user_id"], {"click": "click", "orders": "orders"})


SUMS = ["sum"]
BOTH = ["sum", "mean"]
# What is taken of each log, by prefix: (view, aggregates by column).
USER_LOGS = {
    "search": ("shopper_search_log", {"click": BOTH, "impression": BOTH, "ts_hour": ["nunique"]}),
    "site": ("shopper_sitewide_log", {"cart": BOTH, "click": BOTH, "fav": BOTH, "orders": BOTH, "ts_hour": ["nunique"]}),
    "terms": ("shopper_top_terms_log", {"click": SUMS, "impression": SUMS, "search_term": ["nunique"], "ts_hour": ["nunique"]}),
    "fashion_search": ("event_search_log", {"click": SUMS, "impression": SUMS, "ts_hour": ["nunique"]}),
    "fashion_site": ("event_sitewide_log", {"cart": SUMS, "click": SUMS, "fav": SUMS, "orders": SUMS, "ts_hour": ["nunique"]}),
}
CONTENT_LOGS = {
    "search": ("content_search_log", {"click": BOTH, "impression": BOTH, "date": ["nunique"]}),
    "site": ("content_sitewide_log", {"cart": BOTH, "click": BOTH, "fav": BOTH, "orders": BOTH, "date": ["nunique"]}),
    "terms": ("content_top_terms_log", {"click": SUMS, "impression": SUMS, "search_term": ["nunique"], "date": ["nunique"]}),
}


def _spec_names(prefix, spec):
    return [f"{prefix}_{c}_{fn}" for c, fns in spec.items() for fn in fns]


def _logs_sql(key, ids, logs):
    """All ids of a view, with the aggregates of every log, 0 where a log does not know the id."""
    form = {"sum": "round(cast(sum({c}) as double), 6)", "mean": "round(avg({c}), 6)", "nunique": "count(distinct {c})"}
    parts, out = [], []
    for prefix, (view, spec) in logs.items():
        cells = ", ".join(f"{form[fn].format(c=c)} as {prefix}_{c}_{fn}" for c, fns in spec.items() for fn in fns)
        parts.append(f"l_{prefix} as (select {key}, {cells} from {view} group by 1)")
        out += [f"coalesce({n}, 0) as {n}" for n in _spec_names(prefix, spec)]
    joins = " ".join(f"left join l_{prefix} using ({key})" for prefix in logs)
    return f"""{views(ids, *dict.fromkeys(v for v, _ in logs.values()))}, {", ".join(parts)}
    select {key}, {", ".join(out)} from (select distinct {key} from {ids}) {joins}"""


def _log_aggregates(spark, sf, key, ids, logs):
    base = getattr(fx, ids)(spark, sf).select(key).distinct()
    parts = [aggregates.by_spec(getattr(fx, view)(spark, sf), [key], spec, prefix, 6) for prefix, (view, spec) in logs.items()]
    return aggregates.join_on_key(base, key, *parts).na.fill(0, [n for prefix, (_, spec) in logs.items() for n in _spec_names(prefix, spec)])


@query("agg_user_logs", _logs_sql("user_id", "user_metadata", USER_LOGS))
def agg_user_logs(spark, sf):
    """Every known user with what five logs say, 0 where one does not know the user."""
    return _log_aggregates(spark, sf, "user_id", "user_metadata", USER_LOGS)


@query("agg_content_logs", _logs_sql("content_id", "content_metadata", CONTENT_LOGS))
def agg_content_logs(spark, sf):
    """Every known item with what three logs say, 0 where one does not know the item."""
    return _log_aggregates(spark, sf, "content_id", "content_metadata", CONTENT_LOGS)


@query("agg_user_meta_mode", f"""{views("user_metadata")}, j as (select c_nationkey, u.* from user_metadata u join customer on c_custkey = user_id),
    n as (select c_nationkey, gender, row_number() over (partition by c_nationkey order by count(*) desc, gender) as rn from j where gender is not null group by 1, 2)
    select j.c_nationkey as nation, round(avg(birth_year), 6) as birth_year_mean, round(avg(tenure_days), 6) as tenure_mean, max(n.gender) as gender_mode
    from j left join n on n.c_nationkey = j.c_nationkey and n.rn = 1 group by 1""")
def agg_user_meta_mode(spark, sf):
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    users = fx.user_metadata(spark, sf).join(nation, "user_id")
    means = users.groupBy("nation").agg(F.round(F.avg("birth_year"), 6).alias("birth_year_mean"), F.round(F.avg("tenure_days"), 6).alias("tenure_mean"))
    return means.join(aggregates.mode_per_key(users, ["nation"], "gender", "gender_mode"), "nation", "left")


@query("agg_price_stats", f"""{views("content_price")} select content_id, round(avg(floor(selling_price)), 6) as price_mean, round(avg(rate_count), 6) as rate_count_mean,
    sum(review_count) as review_sum, count(*) as n_prices from content_price group by 1""")
def agg_price_stats(spark, sf):
    return fx.content_price(spark, sf).groupBy("content_id").agg(
        F.round(F.avg(F.floor("selling_price")), 6).alias("price_mean"), F.round(F.avg("rate_count"), 6).alias("rate_count_mean"),
        F.sum("review_count").alias("review_sum"), F.count(F.lit(1)).alias("n_prices"),
    )


def _ctr_sql(log, key, kind):
    return f"select '{kind}' as entity, cast({key} as varchar) as entity_id, round(sum(click) / greatest(sum(impression), 1e-8::double), 9) as ctr from {log} group by all"


@query("agg_ctr_clipped", f"""{views("content_search_log", "event_search_log", "term_search_log")} {_ctr_sql("content_search_log", "content_id", "content")}
    union all {_ctr_sql("event_search_log", "user_id", "user")} union all {_ctr_sql("term_search_log", "search_term", "term")}""")
def agg_ctr_clipped(spark, sf):
    logs = {"content": (fx.content_search_log, "content_id"), "user": (fx.event_search_log, "user_id"), "term": (fx.term_search_log, "search_term")}
    parts = [
        aggregates.clipped_ctr(log(spark, sf), [key], "impression", "click", "ctr").select(
            F.lit(kind).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.round("ctr", 9).alias("ctr")
        )
        for kind, (log, key) in logs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("agg_diversity", f"""{views("shopper_top_terms_log")} select search_term, count(*) as n_rows, count(distinct user_id) as n_user_id, count(distinct ts_hour) as n_ts_hour
    from shopper_top_terms_log group by 1""")
def agg_diversity(spark, sf):
    return aggregates.diversity(fx.shopper_top_terms_log(spark, sf), ["search_term"], ["user_id", "ts_hour"])


def _activity_sql(left, log, key, ts, cols):
    sums = ", ".join(f"sum(l.{c}) as {c}" for c in cols)
    return f"select l.{key}, count(*) as rows, {sums} from (select *, date_trunc('hour', {ts}) as h from {log}) l join {left} s on l.{key} = s.{key} and l.h < s.ts_hour group by 1"


@query("agg_user_activity_past", f"""{views("event_sessions", "event_sitewide_log", "event_search_log")},
    a as ({_activity_sql("event_sessions", "event_sitewide_log", "user_id", "ts_hour", ["click", "cart", "fav", "orders"])}),
    b as ({_activity_sql("event_sessions", "event_search_log", "user_id", "ts_hour", ["impression", "click"])})
    select user_id, coalesce(cast(a.click as bigint), 0) as user_total_clicks, coalesce(cast(a.cart as bigint), 0) as user_total_cart, coalesce(cast(a.fav as bigint), 0) as user_total_fav,
           coalesce(cast(a.orders as bigint), 0) as user_total_orders, coalesce(a.click::double / a.rows, 0) as user_avg_clicks, coalesce(a.rows, 0) as user_activity_rows,
           coalesce(cast(b.impression as bigint), 0) as user_search_impressions, coalesce(b.click::double / nullif(b.impression::double, 0), 0) as user_search_ctr
    from a full join b using (user_id)""")
def agg_user_activity_past(spark, sf):
    asked = fx.event_sessions(spark, sf)
    site = history.past_sums(fx.event_sitewide_log(spark, sf), asked, ["user_id"], ["click", "cart", "fav", "orders"]).select(
        "user_id", F.col("click").alias("user_total_clicks"), F.col("cart").alias("user_total_cart"), F.col("fav").alias("user_total_fav"),
        F.col("orders").alias("user_total_orders"), (F.col("click") / F.col("rows")).alias("user_avg_clicks"), F.col("rows").alias("user_activity_rows"),
    )
    search = history.past_sums(fx.event_search_log(spark, sf), asked, ["user_id"], ["impression", "click"]).select(
        "user_id", F.col("impression").alias("user_search_impressions"), ratio_or(F.col("click").cast("double"), F.col("impression").cast("double")).alias("user_search_ctr")
    )
    return site.join(search, "user_id", "full").na.fill(0)


@query("agg_content_activity_past", f"""{views("sessions", "content_sitewide_log")}, t as (select distinct content_id, ts_hour from sessions),
    a as ({_activity_sql("t", "content_sitewide_log", "content_id", "date", ["click", "cart", "orders"])})
    select content_id, click as content_total_clicks, cast(cart as bigint) as content_total_cart, cast(orders as bigint) as content_total_orders,
           coalesce(cart / nullif(click, 0), 0) as content_cart_rate, coalesce(orders / nullif(click, 0), 0) as content_order_rate, rows as content_active_rows from a""")
def agg_content_activity_past(spark, sf):
    log = fx.content_sitewide_log(spark, sf).withColumnRenamed("date", "ts_hour")
    past = history.past_sums(log, fx.sessions(spark, sf), ["content_id"], ["click", "cart", "orders"])
    return past.select(
        "content_id", F.col("click").alias("content_total_clicks"), F.col("cart").alias("content_total_cart"), F.col("orders").alias("content_total_orders"),
        ratio_or(F.col("cart"), F.col("click")).alias("content_cart_rate"), ratio_or(F.col("orders"), F.col("click")).alias("content_order_rate"),
        F.col("rows").alias("content_active_rows"),
    )


@query("agg_raw_sums", f"""{views("content_sitewide_log", "event_sitewide_log", "term_search_log")}
    select 'content' as entity, cast(content_id as varchar) as entity_id, sum(click) as clicks, count(*) as n_rows from content_sitewide_log group by all
    union all select 'user', cast(user_id as varchar), cast(sum(click) as double), count(*) from event_sitewide_log group by all
    union all select 'term', search_term, cast(sum(click) as double), count(*) from term_search_log group by all""")
def agg_raw_sums(spark, sf):
    logs = {"content": (fx.content_sitewide_log, "content_id"), "user": (fx.event_sitewide_log, "user_id"), "term": (fx.term_search_log, "search_term")}
    parts = [
        log(spark, sf).groupBy(key).agg(F.sum("click").cast("double").alias("clicks"), F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(kind).alias("entity"), F.col(key).cast("string").alias("entity_id"), "clicks", "n_rows"
        )
        for kind, (log, key) in logs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("fit_category_price", f"""{views("content_price", "content_metadata")} select leaf_category, round(avg(floor(selling_price)), 6) as mu, round(stddev_samp(floor(selling_price)), 4) as sigma
    from content_price join content_metadata using (content_id) where update_date < timestamp '2000-01-01' group by 1""")
def fit_category_price(spark, sf):
    meta = fx.content_metadata(spark, sf).select("content_id", "leaf_category")
    train = fx.content_price(spark, sf).where("update_date < timestamp_ntz '2000-01-01 00:00:00'").withColumn("selling_price", F.floor("selling_price"))
    stats = fitted.category_price(train.join(meta, "content_id"), "leaf_category", "selling_price")
    return stats.select("leaf_category", F.round("mu", 6).alias("mu"), F.round("sigma", 4).alias("sigma"))


AFFINITY_SQL = f"""{views("sessions", "content_price")}, p as (select content_id, floor(max(selling_price)) as price from content_price group by 1),
    r as (select s.*, price from sessions s left join p using (content_id)), tr as (select * from r where ts_hour < timestamp '1999-01-01'),
    g as (select user_id, search_term, count(*) as freq, count(distinct content_id) as uniq, avg(price) as ap from tr group by 1, 2),
    m as (select median(ap) as med from tr join g using (user_id, search_term))
    select r.session_id, r.content_id, case when ts_hour < timestamp '1999-01-01' then 'train' else 'test' end as part, coalesce(freq, 0) as user_term_freq,
           coalesce(uniq, 0) as user_term_unique_content, coalesce(ap, (select med from m)) as user_term_avg_price
    from r left join g using (user_id, search_term)"""


@query("fit_user_term_affinity", AFFINITY_SQL)
def fit_user_term_affinity(spark, sf):
    prices = fx.content_price(spark, sf).groupBy("content_id").agg(F.floor(F.max("selling_price")).cast("double").alias("selling_price"))
    rows = fx.sessions(spark, sf, term=True).join(prices, "content_id", "left")
    cut = "timestamp_ntz '1999-01-01 00:00:00'"
    train, test = fitted.user_term_affinity(rows.where(f"ts_hour < {cut}"), rows.where(f"ts_hour >= {cut}"))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("session_id", "content_id", "part", "user_term_freq", "user_term_unique_content", "user_term_avg_price")


@query("fit_user_avg_price", f"""{views("sessions", "content_price")}, l as (select content_id, floor(max(selling_price)) as price from content_price group by 1)
    select user_id, round(avg(price), 6) as user_avg_price from sessions join l using (content_id) where ordered = 1 group by 1""")
def fit_user_avg_price(spark, sf):
    prices = fx.content_price(spark, sf).groupBy("content_id").agg(F.floor(F.max("selling_price")).alias("price"))
    ordered = fx.sessions(spark, sf).where("ordered = 1").join(prices, "content_id")
    return fitted.user_mean_price(ordered, "user_id", "price").withColumn("user_avg_price", F.round("user_avg_price", 6))


@query("agg_class_balance", f"""{views("sessions")}, b as (select 'ordered' as label, sum(ordered) as pos, count(*) - sum(ordered) as neg from sessions
    union all select 'clicked', sum(clicked), count(*) - sum(clicked) from sessions)
    select label, cast(pos as bigint) as pos, cast(neg as bigint) as neg, greatest(neg, 1)::double / greatest(pos, 1)::double as scale_pos_weight, neg::double / (pos + 1) as pos_weight_plus_one from b""")
def agg_class_balance(spark, sf):
    return aggregates.class_balance(fx.sessions(spark, sf), ["ordered", "clicked"])


@query("agg_label_distribution", f"{views('sessions')} select ordered, clicked, count(*) as n from sessions group by all")
def agg_label_distribution(spark, sf):
    return fx.sessions(spark, sf).groupBy("ordered", "clicked").agg(F.count(F.lit(1)).alias("n"))


@query("agg_daily_counts", "select date_trunc('day', ts)::date as day, count(*) as n from events group by 1")
def agg_daily_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_hour_counts", """select 'day' as grain, strftime(ts, '%Y-%m-%d') as bucket, count(*) as n from events group by all
    union all select 'hour', strftime(ts, '%Y-%m-%d %H'), count(*) from events group by all
    union all select 'hour_of_day', cast(hour(ts) as varchar), count(*) from events group by all
    union all select 'weekday', cast(isodow(ts) - 1 as varchar), count(*) from events group by all""")
def agg_hour_counts(spark, sf):
    return aggregates.time_counts(table(spark, sf, "events"), "ts")


# Column types of the tables.
PROFILED = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


def _kind_sql(kind):
    return {"string": "string", "timestamp_ntz": "datetime", "date": "datetime", "boolean": "bool"}.get(kind, "number" if kind in ("bigint", "int", "smallint", "double", "float") else "other")


def _profile_sql():
    rows = []
    for name, columns in PROFILED.items():
        for c, kind in columns.items():
            rows.append(f"""select '{name}' as table_name, '{c}' as column_name, '{kind}' as data_type, '{_kind_sql(kind)}' as kind, count({c}) as non_null_rows, count(distinct {c}) as distinct_values from {name}""")
    ids = profile.ID_NAME.removeprefix("(?i)")
    return f"""with p as ({" union all ".join(rows)}), n as (select *, case when kind <> 'number' then kind
        when regexp_matches(lower(column_name), '{ids}') then 'id-like' when distinct_values <= 20 then 'low-cardinality (' || distinct_values || ')'
        when distinct_values <= 100 and distinct_values <= 0.05::double * non_null_rows then format('low unique ratio ({{:.3f}})', distinct_values::double / non_null_rows)
        else 'continuous' end as note from p)
      select table_name, column_name, data_type, non_null_rows, distinct_values, note, case when note in ('continuous', 'datetime') then 'numeric' else 'categorical' end as role from n"""


@query("profile_columns", _profile_sql())
def profile_columns(spark, sf):
    return profile.profiles({name: table(spark, sf, name) for name in PROFILED})


@query("agg_time_span", f"""{views("sessions")} select 'events' as table_name, min(ts) as first_ts, max(ts) as last_ts from events
    union all select 'sessions', min(ts_hour), max(ts_hour) from sessions""")
def agg_time_span(spark, sf):
    frames = {"events": (table(spark, sf, "events"), "ts"), "sessions": (fx.sessions(spark, sf), "ts_hour")}
    return reduce(DataFrame.unionByName, [
        df.agg(F.min(c).alias("first_ts"), F.max(c).alias("last_ts")).select(F.lit(n).alias("table_name"), "first_ts", "last_ts") for n, (df, c) in frames.items()
    ])


# What the rule finds: the first time-named column with a value that parses, else the first number.
TIME_COLUMNS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderdate", "lineitem": "l_shipdate",
    "events": "ts", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}


@query("date_detect_time_column", " union all ".join(f"select '{t}' as table_name, '{c}' as time_column, count({c}) as n_values from {t}" for t, c in TIME_COLUMNS.items()))
def date_detect_time_column(spark, sf):
    """The time column each table would be split by."""
    found = {n: profile.time_column(table(spark, sf, n)) for n in PROFILED}
    counts = [
        table(spark, sf, n).agg(F.count(c).alias("n_values")).select(F.lit(n).alias("table_name"), F.lit(c).alias("time_column"), "n_values")
        for n, c in found.items() if c is not None
    ]
    return reduce(DataFrame.unionByName, counts)
