"""Projection, typing, null handling and sampling on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionrank.operators import clean
from sessionrank.plans.registry import md5_bucket_sql, query, views
from sessionrank.sources import fixtures as fx
from sessionrank.sources.tables import table


@query("project_rename", f"{views('content_sitewide_log')} select content_id, date as ts_hour, click as csw_click, cart as csw_cart, orders as csw_orders from content_sitewide_log")
def project_rename(spark, sf):
    log = fx.content_sitewide_log(spark, sf)
    renamed = {"date": "ts_hour", **{c: f"csw_{c}" for c in ("click", "cart", "orders")}}
    return clean.project(log, ["content_id", "date", "click", "cart"], ["orders", "labels"], renamed)


@query("coerce_numeric", """select c_custkey, try_cast(case when c_custkey % 2 = 0 then substr(c_name, 10) else c_mktsegment end as double) as raw,
    try_cast(c_mktsegment as double) as segment from customer""")
def coerce_numeric(spark, sf):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.substr("c_name", F.lit(10))).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_custkey", raw.alias("raw"), F.col("c_mktsegment").alias("segment"))
    return clean.coerce_numeric(rows, ["raw", "segment"])


@query("fill_by_type", f"""{views("user_metadata")} select user_id, coalesce(gender, 'UNKNOWN') as gender, coalesce(nullif(birth_year % 10, 0), 0) as decade_year,
    case when user_id % 3 = 0 then null else timestamp '2000-01-01' end as seen from user_metadata""")
def fill_by_type(spark, sf):
    rows = fx.user_metadata(spark, sf).select(
        "user_id", "gender", F.expr("nullif(birth_year % 10, 0)").alias("decade_year"),
        F.expr("case when user_id % 3 = 0 then null else timestamp_ntz '2000-01-01 00:00:00' end").alias("seen"),
    )
    return clean.fill_by_type(rows)


@query("fill_defaults_map", f"""{views("content_price")}, p as (select content_id, update_date, case when rate_count = 7 then null else selling_price end as selling_price,
      nullif(rate_avg, 1) as rate_avg, nullif(review_count, 1) as review_count from content_price)
    select content_id, update_date, coalesce(selling_price, (select round(median(selling_price), 6) from p)) as selling_price, coalesce(rate_avg, 3) as rate_avg,
           coalesce(review_count, 0) as review_count from p""")
def fill_defaults_map(spark, sf):
    rows = fx.content_price(spark, sf).select(
        "content_id", "update_date", F.expr("case when rate_count = 7 then null else selling_price end").alias("selling_price"),
        F.expr("nullif(rate_avg, 1.0D)").alias("rate_avg"), F.expr("nullif(review_count, 1.0D)").alias("review_count"),
    )
    filled = clean.fill_defaults(rows.withColumn("known", F.col("selling_price")), {"rate_avg": 3.0, "review_count": 0.0}, ["selling_price"])
    price = F.when(F.col("known").isNull(), F.round("selling_price", 6)).otherwise(F.col("selling_price"))
    return filled.withColumn("selling_price", price).drop("known")



@query("cleanse_nonfinite", f"""select l_orderkey, l_partkey, case when l_linenumber <= 4 then 0 else l_discount end as rate, l_tax as other from lineitem""")
def cleanse_nonfinite(spark, sf):
    bad = F.expr("case l_linenumber when 1 then double('Infinity') when 2 then double('-Infinity') when 3 then double('NaN') when 4 then null else l_discount end")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", bad.alias("rate"), F.col("l_tax").alias("other"))
    return clean.zero_nonfinite(rows, ["rate", "other"])


@query("sentinel_fill", f"{views('content_metadata')} select content_id, coalesce(merchant_count, -999) as merchant_count, attribute_type_count from content_metadata")
def sentinel_fill(spark, sf):
    return clean.fill_sentinel(fx.content_metadata(spark, sf).select("content_id", "merchant_count", "attribute_type_count"))


@query("mean_fill_price", f"""{views("content_price")}, f as (select content_id, max(selling_price) as price from content_price where rate_count < 3 and review_count < 5 group by 1)
    select m.p_partkey as content_id, coalesce(f.price, (select round(avg(f2.price), 6) from part m2 left join f f2 on f2.content_id = m2.p_partkey)) as price
    from part m left join f on f.content_id = m.p_partkey""")
def mean_fill_price(spark, sf):
    fresh = fx.content_price(spark, sf).where("rate_count < 3 and review_count < 5").groupBy("content_id").agg(F.max("selling_price").alias("price"))
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("content_id"), F.col("p_retailprice").alias("price"))
    known = fresh.select("content_id", F.lit(True).alias("known"))
    filled = clean.replace_with_mean(old, fresh, "content_id", "price").join(known, "content_id", "left")
    return filled.select("content_id", F.when(F.col("known"), F.col("price")).otherwise(F.round("price", 6)).alias("price"))


@query("impute_statistic", f"""{views("user_metadata")}, u as (select user_id, nullif(tenure_days % 1000, 500) as tenure_days, gender from user_metadata),
    f as (select (select median(tenure_days) from u where user_id % 2 = 0) as med,
                 (select gender from u where user_id % 2 = 0 and gender is not null group by 1 order by count(*) desc, gender limit 1) as top)
    select user_id, coalesce(tenure_days::double, f.med) as tenure_days, coalesce(gender, f.top) as gender from u, f""")
def impute_statistic(spark, sf):
    rows = fx.user_metadata(spark, sf).select("user_id", F.expr("nullif(tenure_days % 1000, 500)").cast("double").alias("tenure_days"), "gender")
    return clean.impute(rows.where("user_id % 2 = 0"), rows, ["tenure_days"], ["gender"])


@query("impute_flags", f"""{views("user_metadata")} select user_id, coalesce(gender, 'missing') as gender, case when gender is null then 1 else 0 end as gender_missing,
    coalesce(nullif(birth_year, 1970), 0) as birth_year, case when birth_year = 1970 then 1 else 0 end as birth_year_missing from user_metadata""")
def impute_flags(spark, sf):
    rows = fx.user_metadata(spark, sf).select("user_id", "gender", F.expr("nullif(birth_year, 1970)").alias("birth_year"))
    return clean.flag_missing(rows, ["gender", "birth_year"])


@query("dedup_by_key", f"""{views("content_price")} select content_id, update_date, selling_price, rate_avg from (select *, row_number() over
    (partition by content_id order by update_date, selling_price, rate_avg) as rn from content_price) where rn = 1""")
def dedup_by_key(spark, sf):
    rows = fx.content_price(spark, sf).select("content_id", "update_date", "selling_price", "rate_avg")
    return clean.first_per_key(rows, ["content_id"], ["update_date", "selling_price", "rate_avg"])


@query("filter_positive", f"{views('sessions')} select session_id, content_id, ordered, clicked from sessions where ordered = 1 or clicked = 1")
def filter_positive(spark, sf):
    return fx.sessions(spark, sf).where("ordered = 1 or clicked = 1").select("session_id", "content_id", "ordered", "clicked")


@query("filter_score_band", """select p_partkey, p_brand, p_size, p_name from part
    where p_brand in ('Brand#1', 'Brand#2', 'Brand#3') and p_size between 10 and 40 and regexp_matches(p_name, 'ring|gear')""")
def filter_score_band(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return rows.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & F.col("p_size").between(10, 40) & F.col("p_name").rlike("ring|gear"))


def _with_meta(spark, sf):
    meta = fx.content_metadata(spark, sf).select("content_id", "leaf_category", "cv_tags", "attribute_type_count", "creation_date")
    return fx.sessions(spark, sf).join(meta, "content_id", "left")


WITH_META = f"{views('sessions', 'content_metadata')} select {{cols}} from sessions left join content_metadata using (content_id)"


@query("select_features", WITH_META.format(cols="p_order, p_click, leaf_category, cv_tags, attribute_type_count"))
def select_features(spark, sf):
    return clean.features(_with_meta(spark, sf), strict=True)


@query("select_categoricals", WITH_META.format(cols="leaf_category, cv_tags"))
def select_categoricals(spark, sf):
    rows = clean.features(_with_meta(spark, sf), strict=True)
    return rows.select(*clean.categoricals(rows))


@query("select_per_head", f"""{views("sessions")} select session_id, content_id, 'clicked' as head, p_order, p_click from sessions
    union all select session_id, content_id, 'ordered', null, null from sessions""")
def select_per_head(spark, sf):
    heads = clean.per_head(fx.sessions(spark, sf).select("session_id", "content_id", "p_order", "p_click"), ["p_order", "p_click"])
    parts = [df.withColumn("head", F.lit(name)) for name, df in heads.items()]
    return parts[1].unionByName(parts[0], allowMissingColumns=True)


@query("sample_whole_sessions", f"""{views("sessions")} select session_id, content_id from sessions
    where session_id in (select distinct session_id from sessions order by 1 limit 100)""")
def sample_whole_sessions(spark, sf):
    return clean.whole_sessions(fx.sessions(spark, sf).select("session_id", "content_id"), 5000)


@query("sample_stratified", f"""{views("sessions")} select session_id, content_id, ordered, clicked from sessions
    where {md5_bucket_sql("'42|' || session_id || '|' || content_id", 100)} < 20""")
def sample_stratified(spark, sf):
    """A fifth of the rows by hash, in each label the same share."""
    sample, _ = clean.hash_bucket_split(fx.sessions(spark, sf).select("session_id", "content_id", "ordered", "clicked"), ["session_id", "content_id"], 20)
    return sample


@query("flag_presence", f"""{views("content_metadata")} select content_id, level2_category is not null as has_level2_category, cv_tags is not null as has_cv_tags,
    coalesce(level2_category, 'UNKNOWN') as level2_clean, coalesce(merchant_count, 1) as merchant_count, coalesce(attribute_type_count, 0) as attribute_type_count from content_metadata""")
def flag_presence(spark, sf):
    flagged = clean.presence_flags(
        fx.content_metadata(spark, sf), ["level2_category", "cv_tags"], {"level2_category": "level2_clean"}, {"merchant_count": 1.0, "attribute_type_count": 0.0}
    )
    return flagged.select("content_id", "has_level2_category", "has_cv_tags", "level2_clean", "merchant_count", "attribute_type_count")
