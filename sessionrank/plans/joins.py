"""Static, as-of and strictly-past joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionrank.operators import aggregates, fitted, history
from sessionrank.operators.aggregates import join_on_key
from sessionrank.operators.enrich import ctr, enrich, site_rates
from sessionrank.operators.history import Latest, Running
from sessionrank.plans.registry import query, views
from sessionrank.sources import fixtures as fx

SITE = {"click": "click", "cart": "cart", "fav": "fav", "orders": "orders"}
SEARCH = {"impression": "impression", "click": "click"}


def _prefixed(prefix, names):
    return {f"{prefix}_{n}": n for n in names}


def _filled(df, keep, names):
    return df.select(*keep, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])


def _running_sql(log, keys, ts, prefix, names):
    """Per (key, hour) sums and their running totals, written for the check engine."""
    k = ", ".join(keys)
    inner = ", ".join(f"sum({n}) as {n}" for n in names)
    outer = ", ".join(f"sum({n}) over (partition by {k} order by ts_hour) as {prefix}_{n}" for n in names)
    return f"select {k}, ts_hour, {outer} from (select {k}, date_trunc('hour', {ts}) as ts_hour, {inner} from {log} group by all)"


def _rates_sql(prefix):
    return ", ".join(
        f"({prefix}_{c} + 1.0::double) / ({prefix}_click + 1.0::double) as {prefix}_{n}_rate"
        for n, c in (("order", "orders"), ("cart", "cart"), ("fav", "fav"))
    )


def _ctr_sql(prefix):
    return f"({prefix}_click + 1.0::double) / ({prefix}_impression + 1.0::double) as {prefix}_ctr"


def _asof_sql(left, log, keys, ts, prefix, names, rates, keep):
    on = " and ".join(f"s.{k} = h.{k}" for k in keys)
    cols = [f"{prefix}_{n}" for n in names]
    rate_cols = [f"{prefix}_{r}" for r in rates]
    out = ", ".join(f"coalesce(cast(h.{c} as double), 0) as {c}" for c in cols + rate_cols)
    rate_sql = _rates_sql(prefix) if "order_rate" in rates else _ctr_sql(prefix)
    return f"""{views(left, log)},
      h as (select *, {rate_sql} from ({_running_sql(log, keys, ts, prefix, names)}))
      select {", ".join("s." + k for k in keep)}, {out}
      from {left} s asof left join h on {on} and s.ts_hour >= h.ts_hour"""


SESSION_KEEP = ["session_id", "content_id", "user_id", "ts_hour"]


def _asof_running(left, log, keys, ts, prefix, names, rates, keep):
    joined = history.as_of(left, keys, [Running(log, _prefixed(prefix, names), ts)])
    joined = joined.withColumns(rates)
    return _filled(joined, keep, [f"{prefix}_{n}" for n in names] + list(rates))


RATE_NAMES = ["order_rate", "cart_rate", "fav_rate"]


@query("asof_content_sitewide", _asof_sql("sessions", "content_sitewide_log", ["content_id"], "date", "csw", SITE, RATE_NAMES, SESSION_KEEP))
def asof_content_sitewide(spark, sf):
    return _asof_running(fx.sessions(spark, sf), fx.content_sitewide_log(spark, sf), ["content_id"], "date", "csw", SITE, site_rates("csw"), SESSION_KEEP)


@query("asof_content_search", _asof_sql("sessions", "content_search_log", ["content_id"], "date", "cs", SEARCH, ["ctr"], SESSION_KEEP))
def asof_content_search(spark, sf):
    return _asof_running(fx.sessions(spark, sf), fx.content_search_log(spark, sf), ["content_id"], "date", "cs", SEARCH, ctr("cs"), SESSION_KEEP)


@query(
    "asof_term_content",
    _asof_sql("sessions", "content_top_terms_log", ["content_id", "search_term"], "date", "tc", SEARCH, ["ctr"], [*SESSION_KEEP, "search_term"]),
)
def asof_term_content(spark, sf):
    left, log = fx.sessions(spark, sf, term=True), fx.content_top_terms_log(spark, sf)
    return _asof_running(left, log, ["content_id", "search_term"], "date", "tc", SEARCH, ctr("tc"), [*SESSION_KEEP, "search_term"])


@query("asof_user_sitewide", _asof_sql("event_sessions", "event_sitewide_log", ["user_id"], "ts_hour", "usw", SITE, RATE_NAMES, ["user_id", "ts_hour"]))
def asof_user_sitewide(spark, sf):
    left, log = fx.event_sessions(spark, sf), fx.event_sitewide_log(spark, sf)
    return _asof_running(left, log, ["user_id"], "ts_hour", "usw", SITE, site_rates("usw"), ["user_id", "ts_hour"])


@query("asof_user_search", _asof_sql("event_sessions", "event_search_log", ["user_id"], "ts_hour", "us", SEARCH, ["ctr"], ["user_id", "ts_hour"]))
def asof_user_search(spark, sf):
    left, log = fx.event_sessions(spark, sf), fx.event_search_log(spark, sf)
    return _asof_running(left, log, ["user_id"], "ts_hour", "us", SEARCH, ctr("us"), ["user_id", "ts_hour"])


@query("asof_term_search", _asof_sql("sessions", "term_search_log", ["search_term"], "ts_hour", "ts", SEARCH, ["ctr"], [*SESSION_KEEP, "search_term"]))
def asof_term_search(spark, sf):
    left, log = fx.sessions(spark, sf, term=True), fx.term_search_log(spark, sf)
    return _asof_running(left, log, ["search_term"], "ts_hour", "ts", SEARCH, ctr("ts"), [*SESSION_KEEP, "search_term"])


PRICE_COLS = ["selling_price", "original_price", "review_count", "rate_count", "rate_avg"]
PRICE_SNAPSHOTS = f"""p as (select * from (select content_id, date_trunc('hour', update_date) as ts_hour, {", ".join(PRICE_COLS)},
      row_number() over (partition by content_id, date_trunc('hour', update_date) order by {", ".join(c + " desc" for c in PRICE_COLS)}) as rn
      from content_price) where rn = 1)"""


@query(
    "asof_price",
    f"""{views("sessions", "content_price")}, {PRICE_SNAPSHOTS}
    select {", ".join("s." + k for k in SESSION_KEEP)}, {", ".join(f"coalesce(p.{c}, 0) as {c}" for c in PRICE_COLS)}
    from sessions s asof left join p on s.content_id = p.content_id and s.ts_hour >= p.ts_hour""",
)
def asof_price(spark, sf):
    prices = Latest(fx.content_price(spark, sf), PRICE_COLS, "update_date")
    joined = history.as_of(fx.sessions(spark, sf), ["content_id"], [prices])
    return joined.select(*SESSION_KEEP, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in PRICE_COLS])


@query(
    "asof_user_content_clicks",
    f"""{views("supplier_sessions", "user_content_log")},
    h as (select user_id, content_id, date_trunc('hour', ts_hour) as ts_hour,
                 count(*) filter (total_click > 0) as n from user_content_log group by all),
    c as (select user_id, content_id, ts_hour, sum(n) over (partition by user_id, content_id order by ts_hour) as n from h)
    select s.session_id, s.user_id, s.content_id, s.ts_hour, cast(coalesce(c.n, 0) as bigint) as user_content_past_click_count
    from supplier_sessions s asof left join c on s.user_id = c.user_id and s.content_id = c.content_id and s.ts_hour >= c.ts_hour""",
)
def asof_user_content_clicks(spark, sf):
    clicks = Running(fx.user_content_log(spark, sf), {"n": F.when(F.col("total_click") > 0, 1).otherwise(0)})
    joined = history.as_of(fx.supplier_sessions(spark, sf), ["user_id", "content_id"], [clicks])
    return joined.select(
        "session_id", "user_id", "content_id", "ts_hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("user_content_past_click_count")
    )


@query(
    "asof_strictly_before",
    f"""{views("event_sessions", "event_search_log")},
    h as ({_running_sql("event_search_log", ["user_id"], "ts_hour", "us", SEARCH)})
    select s.user_id, s.ts_hour, coalesce(cast(h.us_impression as double), 0) as us_impression, coalesce(cast(h.us_click as double), 0) as us_click
    from event_sessions s asof left join h on s.user_id = h.user_id and s.ts_hour > h.ts_hour""",
)
def asof_strictly_before(spark, sf):
    source = Running(fx.event_search_log(spark, sf), _prefixed("us", SEARCH))
    joined = history.as_of(fx.event_sessions(spark, sf), ["user_id"], [source], strict=True)
    return _filled(joined, ["user_id", "ts_hour"], ["us_impression", "us_click"])


# ---- the full table of as-of and static features

META_NUM = ["attribute_type_count", "total_attribute_option_count", "merchant_count", "filterable_label_count"]
RUNNING_PARTS = {
    # prefix: (log view, keys, time column, counters)
    "csw": ("content_sitewide_log", ["content_id"], "date", SITE),
    "cs": ("content_search_log", ["content_id"], "date", SEARCH),
    "tc": ("content_top_terms_log", ["content_id", "search_term"], "date", SEARCH),
    "usw": ("shopper_sitewide_log", ["user_id"], "ts_hour", SITE),
    "us": ("shopper_search_log", ["user_id"], "ts_hour", SEARCH),
    "ts": ("term_search_log", ["search_term"], "ts_hour", SEARCH),
}


def _enrich_sql():
    parts, joins, cols = [], [], []
    for p, (log, keys, ts, names) in RUNNING_PARTS.items():
        rates = _rates_sql(p) if len(names) == 4 else _ctr_sql(p)
        parts.append(f"{p} as (select *, {rates} from ({_running_sql(log, keys, ts, p, names)}))")
        joins.append(f"asof left join {p} on " + " and ".join(f"s.{k} = {p}.{k}" for k in keys) + f" and s.ts_hour >= {p}.ts_hour")
        out = [f"{p}_{n}" for n in names] + ([f"{p}_{r}" for r in RATE_NAMES] if len(names) == 4 else [f"{p}_ctr"])
        cols += [f"coalesce(cast({p}.{c} as double), 0) as {c}" for c in out]
    price = ", ".join(f"coalesce(p.{c}, 0) as {c}" for c in PRICE_COLS)
    meta = ", ".join(f"coalesce(m.{c}, 0) as {c}" for c in META_NUM)
    names = ["sessions", "content_price", "content_metadata", "user_metadata", *[v[0] for v in RUNNING_PARTS.values()]]
    return f"""{views(*names)}, {PRICE_SNAPSHOTS}, {", ".join(parts)}
      select s.session_id, s.content_id, s.user_id, s.ts_hour, s.search_term, s.ordered, s.clicked,
             hour(s.ts_hour) as hour_of_day, cast(isodow(s.ts_hour) - 1 as bigint) as day_of_week,
             coalesce(m.leaf_category, 'UNKNOWN') as leaf_category, {meta},
             coalesce(u.gender, 'UNKNOWN') as gender, coalesce(u.birth_year, 0) as birth_year, coalesce(u.tenure_days, 0) as tenure_days,
             {price}, {", ".join(cols)}
      from sessions s left join content_metadata m on s.content_id = m.content_id left join user_metadata u on s.user_id = u.user_id
      asof left join p on s.content_id = p.content_id and s.ts_hour >= p.ts_hour
      {" ".join(joins)}"""


@query("asof_enrich_all", _enrich_sql())
def asof_enrich_all(spark, sf):
    return enriched(spark, sf)


def enriched(spark, sf):
    """Sessions with every static and as-of feature, nulls filled by type."""
    items, shoppers = fx.item_log(spark, sf), fx.shopper_log(spark, sf)
    search = {"impression": "impression", "click": "search_click"}
    logs = {
        "csw": (items, ["content_id"], "date", SITE),
        "cs": (items, ["content_id"], "date", search),
        "tc": (fx.content_top_terms_log(spark, sf), ["content_id", "search_term"], "date", SEARCH),
        "usw": (shoppers, ["user_id"], "ts_hour", SITE),
        "us": (shoppers, ["user_id"], "ts_hour", search),
        "ts": (fx.term_search_log(spark, sf), ["search_term"], "ts_hour", SEARCH),
    }
    return enrich(
        fx.session_items(spark, sf, dealt=True).select("session_id", "content_id", "ordered", "clicked"),
        fx.content_metadata(spark, sf).select("content_id", "leaf_category", *META_NUM),
        fx.user_metadata(spark, sf),
        Latest(items, PRICE_COLS, "date"),
        logs,
        heads=fx.session_heads(spark, sf),
        asked=items,
    )


@query("join_static_enrich", f"""{views("sessions", "content_metadata", "user_metadata")}
    select s.session_id, s.content_id, s.user_id, s.ts_hour, m.leaf_category, m.cv_tags, m.attribute_type_count, u.gender, u.birth_year, u.tenure_days
    from sessions s left join content_metadata m on s.content_id = m.content_id left join user_metadata u on s.user_id = u.user_id""")
def join_static_enrich(spark, sf):
    meta = fx.content_metadata(spark, sf).select("content_id", "leaf_category", "cv_tags", "attribute_type_count")
    rows = fx.sessions(spark, sf).select(*SESSION_KEEP)
    return rows.join(meta, "content_id", "left").join(fx.user_metadata(spark, sf), "user_id", "left")


# ---- strictly-past range joins

@query("temporal_range_join", f"""{views("event_sessions", "event_sitewide_log")}
    select l.user_id, l.ts_hour, l.click, l.cart, l.fav, l.orders, count(*) as later_hours
    from (select *, row_number() over () as rid from event_sitewide_log) l
    join event_sessions s on l.user_id = s.user_id and l.ts_hour < s.ts_hour group by l.rid, l.user_id, l.ts_hour, l.click, l.cart, l.fav, l.orders""")
def temporal_range_join(spark, sf):
    return history.past_multiplicity(fx.event_sitewide_log(spark, sf), fx.event_sessions(spark, sf), ["user_id"])


@query("temporal_range_join_content", f"""{views("sessions", "content_sitewide_log")},
    a as (select distinct content_id, ts_hour from sessions)
    select l.content_id, l.date, l.click, l.cart, l.fav, l.orders, count(*) as later_hours
    from (select *, row_number() over () as rid from content_sitewide_log) l join a on l.content_id = a.content_id and l.date < a.ts_hour
    group by l.rid, l.content_id, l.date, l.click, l.cart, l.fav, l.orders""")
def temporal_range_join_content(spark, sf):
    return history.past_multiplicity(fx.content_sitewide_log(spark, sf), fx.sessions(spark, sf), ["content_id"], log_ts="date")


# ---- aggregates joined on one key, and other joins

@query("join_feature_chain", f"""{views("user_metadata", "shopper_sitewide_log", "shopper_search_log", "shopper_top_terms_log")},
    a as (select user_id, round(sum(click), 2) as site_click_sum, count(*) as site_rows from shopper_sitewide_log group by 1),
    b as (select user_id, round(sum(impression), 2) as search_impression_sum from shopper_search_log group by 1),
    c as (select user_id, count(distinct search_term) as n_terms from shopper_top_terms_log group by 1)
    select u.user_id, u.tenure_days, coalesce(site_click_sum, 0) as site_click_sum, coalesce(site_rows, 0) as site_rows,
           coalesce(search_impression_sum, 0) as search_impression_sum, coalesce(n_terms, 0) as n_terms
    from user_metadata u left join a using (user_id) left join b using (user_id) left join c using (user_id)""")
def join_feature_chain(spark, sf):
    return join_on_key(
        fx.user_metadata(spark, sf).select("user_id", "tenure_days"),
        "user_id",
        fx.shopper_sitewide_log(spark, sf).groupBy("user_id").agg(F.round(F.sum("click"), 2).alias("site_click_sum"), F.count("*").alias("site_rows")),
        fx.shopper_search_log(spark, sf).groupBy("user_id").agg(F.round(F.sum("impression"), 2).alias("search_impression_sum")),
        fx.shopper_top_terms_log(spark, sf).groupBy("user_id").agg(F.count_distinct("search_term").alias("n_terms")),
    ).na.fill(0)


@query("join_fanout_prices", f"""{views("content_metadata", "content_price")}
    select m.content_id, m.leaf_category, count(p.content_id) as n_prices, count(*) as n_rows, max(p.selling_price) as top_price
    from content_metadata m left join content_price p using (content_id) group by all""")
def join_fanout_prices(spark, sf):
    fanned = fx.content_metadata(spark, sf).select("content_id", "leaf_category").join(
        fx.content_price(spark, sf).select("content_id", "selling_price", F.lit(1).alias("hit")), "content_id", "left"
    )
    return fanned.groupBy("content_id", "leaf_category").agg(
        F.count("hit").alias("n_prices"), F.count(F.lit(1)).alias("n_rows"), F.max("selling_price").alias("top_price")
    )


@query("join_fitted_stats", f"""{views("sessions", "content_metadata", "content_price")},
    f as (select leaf_category, avg(selling_price) as mu, stddev_samp(selling_price) as sigma
          from content_price join content_metadata using (content_id) group by 1)
    select content_id, leaf_category, round(mu, 4) as mu, round(sigma, 4) as sigma from content_metadata left join f using (leaf_category)""")
def join_fitted_stats(spark, sf):
    meta = fx.content_metadata(spark, sf).select("content_id", "leaf_category")
    stats = fitted.category_price(fx.content_price(spark, sf).join(meta, "content_id"), "leaf_category", "selling_price")
    return meta.join(stats, "leaf_category", "left").select("content_id", "leaf_category", F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"))


@query("join_global_scalar", f"""{views("sessions")}
    select session_id, content_id, (select max(ts_hour) from sessions) as present_time, (select round(avg(p_order), 6) from sessions) as mean_score
    from sessions""")
def join_global_scalar(spark, sf):
    rows = fx.sessions(spark, sf)
    return rows.select(
        "session_id", "content_id",
        rows.select(F.max("ts_hour")).scalar().alias("present_time"),
        rows.select(F.round(F.avg("p_order"), 6)).scalar().alias("mean_score"),
    )


@query("semi_join_sessions", f"""{views("sessions")}
    select session_id, content_id, ts_hour from sessions where session_id in (select session_id from sessions where ordered = 1)""")
def semi_join_sessions(spark, sf):
    rows = fx.sessions(spark, sf)
    chosen = rows.where("ordered = 1").select("session_id")
    return rows.select("session_id", "content_id", "ts_hour").join(chosen, "session_id", "left_semi")


@query("anti_join_missing_sessions", f"""{views("sessions")}
    select count(distinct session_id) as n_missing from sessions
    where session_id not in (select session_id from sessions group by 1 having count(*) > 1)""")
def anti_join_missing_sessions(spark, sf):
    rows = fx.sessions(spark, sf).select("session_id")
    submitted = rows.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(submitted, "session_id", "left_anti").agg(F.count_distinct("session_id").alias("n_missing"))


@query("join_train_user_price", f"""{views("sessions", "content_price")},
    latest as (select * from (select content_id, selling_price, row_number() over (partition by content_id
               order by update_date desc, selling_price desc) as rn from content_price) where rn = 1),
    u as (select s.user_id, avg(selling_price) as user_avg_price from sessions s left join latest using (content_id) where ordered = 1 group by 1)
    select s.session_id, s.content_id, round(coalesce(u.user_avg_price, (select avg(user_avg_price) from u)), 4) as user_avg_price,
           round(l.selling_price / coalesce(u.user_avg_price, (select avg(user_avg_price) from u)), 6) as price_ratio
    from sessions s left join latest l using (content_id) left join u using (user_id)""")
def join_train_user_price(spark, sf):
    rows = fx.sessions(spark, sf)
    prices = aggregates.latest(fx.content_price(spark, sf), ["content_id"], ["update_date", "selling_price"], ["selling_price"]).drop("update_date")
    priced = rows.join(prices, "content_id", "left")
    with_mean = fitted.add_user_mean_price(priced, fitted.user_mean_price(priced.where("ordered = 1"), "user_id", "selling_price"))
    ratio = F.try_divide(F.col("selling_price"), F.col("user_avg_price"))
    return with_mean.select("session_id", "content_id", F.round("user_avg_price", 4).alias("user_avg_price"), F.round(ratio, 6).alias("price_ratio"))


@query("attach_scores", f"""{views("sessions")}
    select a.session_id, a.content_id, b.score from sessions a
    join (select session_id, content_id, round(p_order * 0.7::double + p_click * 0.3::double, 8) as score from sessions) b using (session_id, content_id)""")
def attach_scores(spark, sf):
    rows = fx.sessions(spark, sf)
    score = (F.col("p_order") * 0.7 + F.col("p_click") * 0.3)
    scores = rows.select("session_id", "content_id", F.round(score, 8).alias("score"))
    return rows.select("session_id", "content_id").join(scores, ["session_id", "content_id"])
