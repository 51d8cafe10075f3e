"""Text, calendar, price, bucket, array and hash expressions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionrank.functions import affinity, dates, hashing, rates, text
from sessionrank.operators import encode, fitted, profile
from sessionrank.plans.registry import md5_bucket_sql, query, views
from sessionrank.sources import fixtures as fx
from sessionrank.sources.tables import table

RAW_TERM = "case p_partkey % 5 when 0 then '  ' || upper(p_name) || ' ' when 1 then 'NaN' when 2 then null when 3 then ' none ' else p_name end"


@query("str_normalize_term", f"select p_partkey, case when t is null or t in ('nan', 'none', 'null', '') then '' else t end as term from (select p_partkey, lower(trim({RAW_TERM})) as t from part)")
def str_normalize_term(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.normalize_term(F.expr(RAW_TERM)).alias("term"))


@query("str_product_text", f"""{views("content_metadata")} select content_id, case when concat_ws(' ', level2_category, case when content_id % 3 = 0 then cv_tags end) = '' then cast(content_id as varchar)
    else concat_ws(' ', level2_category, case when content_id % 3 = 0 then cv_tags end) end as product_text from content_metadata""")
def str_product_text(spark, sf):
    tags = F.when(F.col("content_id") % 3 == 0, F.col("cv_tags"))
    return fx.content_metadata(spark, sf).select("content_id", text.product_text(F.col("level2_category"), tags, fallback=F.col("content_id")).alias("product_text"))


@query("str_term_shape", "select p_partkey, length(t) as term_length, length(t) - length(replace(t, '_', '')) as term_underscores from (select p_partkey, replace(p_name || '_' || p_type, ' ', '_') as t from part)")
def str_term_shape(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.replace(F.concat_ws("_", "p_name", "p_type"), F.lit(" "), F.lit("_")).alias("t"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in text.term_shape(F.col("t")).items()])


@query("str_keyword_flags", """select p_partkey, regexp_matches(p_name, 'nike|adidas|zara|h&m|mango') as is_brand_search, regexp_matches(p_name, 'siyah|beyaz|kirmizi|mavi|yesil|sari') as is_color_search,
    regexp_matches(p_name, 'red|blue|green') as is_english_color from part""")
def str_keyword_flags(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", text.contains_word(name, text.BRAND_WORDS).alias("is_brand_search"), text.contains_word(name, text.COLOUR_WORDS).alias("is_color_search"),
        text.contains_word(name, "red|blue|green").alias("is_english_color"),
    )


@query("str_tokenize", r"""select doc_id, len(string_split(text, ' ')) as n_by_blank, len([t for t in regexp_split_to_array(text, '[ \t\n\r\f\v]+') if t <> '']) as n_tokens from documents""")
def str_tokenize(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.size(text.tokens_by_blank(F.col("text"))).cast("bigint").alias("n_by_blank"), F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens")
    )


@query("str_multiword_columns", r"""select 'p_name' as column_name, bool_or(regexp_matches(p_name, '\s')) as multiword from part union all select 'p_brand', bool_or(regexp_matches(p_brand, '\s')) from part
    union all select 'p_type', bool_or(regexp_matches(p_type, '\s')) from part""")
def str_multiword_columns(spark, sf):
    return profile.multiword_columns(table(spark, sf, "part"))


@query("str_key_cast", f"{views('user_metadata')} select user_id, cast(user_id as varchar) as user_key, coalesce(gender, 'UNKNOWN') as gender_key from user_metadata")
def str_key_cast(spark, sf):
    return fx.user_metadata(spark, sf).select("user_id", text.key_text(F.col("user_id")).alias("user_key"), text.key_text(F.col("gender")).alias("gender_key"))


@query("date_floor_hour", "select event_id, date_trunc('hour', case when event_id % 7 = 0 then null else ts end) as ts_hour from events")
def date_floor_hour(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("no time")).otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", dates.parse_hour(raw).alias("ts_hour"))


@query("date_parts", "select event_id, hour(ts) as hour_of_day, isodow(ts) - 1 as day_of_week, isodow(ts) as iso_weekday, day(ts) as day_of_month from events")
def date_parts(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in dates.calendar_parts(F.col("ts")).items()])


@query("date_weekend_period", """select event_id, isodow(ts) >= 5 as is_weekend, case when hour(ts) between 6 and 12 then 'morning' when hour(ts) between 13 and 18 then 'afternoon'
    when hour(ts) between 19 and 23 then 'evening' else 'night' end as time_period from events""")
def date_weekend_period(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.is_weekend(F.col("ts")).alias("is_weekend"), dates.time_period(F.col("ts")).alias("time_period"))


@query("date_item_age", f"""{views("sessions", "content_metadata")} select content_id, date_diff('day', creation_date, (select max(ts_hour) from sessions)) as product_age_days,
    date_diff('day', creation_date, timestamp '2025-07-12') as content_age_days from content_metadata""")
def date_item_age(spark, sf):
    present = fx.sessions(spark, sf).select(F.max("ts_hour")).scalar()
    fixed = F.lit("2025-07-12").cast("timestamp_ntz")
    return fx.content_metadata(spark, sf).select(
        "content_id", dates.whole_days_between(F.col("creation_date"), present).alias("product_age_days"), dates.whole_days_between(F.col("creation_date"), fixed).alias("content_age_days")
    )


@query("date_user_age", f"""{views("sessions", "user_metadata")} select user_id, coalesce((select year(max(ts_hour)) from sessions) - nullif(birth_year, 1970), -1) as user_age,
    coalesce(2025 - nullif(birth_year, 1970), -1) as user_age_2025, 2025 - coalesce(nullif(birth_year, 1970), 1990) as user_age_default from user_metadata""")
def date_user_age(spark, sf):
    year = fx.sessions(spark, sf).select(F.year(F.max("ts_hour"))).scalar()
    born = F.expr("nullif(birth_year, 1970)")
    return fx.user_metadata(spark, sf).select(
        "user_id", dates.age_from_birth_year(year, born).alias("user_age"), dates.age_from_birth_year(F.lit(2025), born).alias("user_age_2025"),
        dates.age_from_birth_year(F.lit(2025), F.coalesce(born, F.lit(1990))).alias("user_age_default"),
    )


@query("date_strip_tz", "select event_id, ts as ts_plain, ts < timestamp '2024-01-15' as early from events")
def date_strip_tz(spark, sf):
    plain = dates.strip_zone(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", plain.alias("ts_plain"), (plain < F.lit("2024-01-15").cast("timestamp_ntz")).alias("early"))


@query("math_smoothed_rate", f"{views('content_search_log')} select content_id, (count(*) + 1.0::double) / (sum(impression) + 1.0::double) as ctr from content_search_log group by 1")
def math_smoothed_rate(spark, sf):
    sums = fx.content_search_log(spark, sf).groupBy("content_id").agg(F.sum("click").alias("c"), F.sum("impression").alias("i"))
    return sums.select("content_id", rates.smoothed(F.col("c"), F.col("i")).alias("ctr"))


# half of the rows get an original price below the selling price, some get 0
ORIGINAL = "case when rate_count = 1 then 0 when rate_count = 2 then selling_price * 0.5 else original_price end"


@query("math_discount_pct", f"""{views("content_price")}, o as (select content_id, update_date, rate_count, selling_price, {ORIGINAL.replace("0.5", "0.5::double")} as original from content_price)
    select content_id, update_date, rate_count, round(case when greatest(original, selling_price) > 0 then (greatest(original, selling_price) - selling_price) / greatest(original, selling_price) else 0 end * 100, 7) as discount_pct,
           round((original - selling_price) / nullif(original, 0) * 100, 7) as discount_raw from o""")
def math_discount_pct(spark, sf):
    rows = fx.content_price(spark, sf).withColumn("original", F.expr(ORIGINAL.replace("0.5", "0.5D")))
    pair = (F.col("original"), F.col("selling_price"))
    return rows.select(
        "content_id", "update_date", "rate_count", F.round(rates.discount_pct(*pair), 7).alias("discount_pct"), F.round(rates.discount_pct_raw(*pair), 7).alias("discount_raw")
    )


@query("math_ctr_transforms", f"""{views("content_top_terms_log")}, c as (select content_id, search_term, (count(*) + 1.0::double) / (sum(impression) + 1.0::double) as ctr,
      count(*) / sum(impression) as raw from content_top_terms_log group by 1, 2)
    select content_id, search_term, round(sqrt(ctr), 9) as ctr_sqrt, round(ln(1 + ctr), 9) as ctr_log1p, round((raw + 1e-6::double) / (ctr + 1e-6::double), 9) as term_over_content_ctr from c""")
def math_ctr_transforms(spark, sf):
    sums = fx.content_top_terms_log(spark, sf).groupBy("content_id", "search_term").agg(F.sum("click").alias("c"), F.sum("impression").alias("i"))
    rows = sums.select("content_id", "search_term", rates.smoothed(F.col("c"), F.col("i")).alias("ctr"), (F.col("c") / F.col("i")).alias("raw"))
    return rows.select(
        "content_id", "search_term", *[F.round(c, 9).alias(n) for n, c in rates.ctr_transforms(F.col("ctr")).items()],
        F.round(rates.both_sides_ratio(F.col("raw"), F.col("ctr")), 9).alias("term_over_content_ctr"),
    )


@query("math_price_ratio", f"""{views("sessions", "content_price")}, l as (select content_id, floor(max(selling_price)) as price from content_price group by 1),
    u as (select user_id, avg(price) as user_price from sessions join l using (content_id) group by 1)
    select s.session_id, s.content_id, round(price / user_price, 9) as price_ratio from sessions s join l using (content_id) join u using (user_id)""")
def math_price_ratio(spark, sf):
    prices = fx.content_price(spark, sf).groupBy("content_id").agg(F.floor(F.max("selling_price")).alias("price"))
    rows = fx.sessions(spark, sf).join(prices, "content_id")
    means = rows.groupBy("user_id").agg(F.avg("price").alias("user_price"))
    return rows.join(means, "user_id").select("session_id", "content_id", F.round(F.try_divide(F.col("price"), F.col("user_price")), 9).alias("price_ratio"))


@query("math_category_z", f"""{views("content_price", "content_metadata")}, l as (select content_id, coalesce(m.leaf_category, 'UNKNOWN') as leaf_category, floor(max(selling_price)) as price
      from content_price left join content_metadata as m using (content_id) group by 1, 2),
    g as (select leaf_category, avg(price) as mu, stddev_samp(price) as sigma from l group by 1)
    select content_id, leaf_category, round(case when sigma > 0 then (price - mu) / sigma else 0 end, 7) as price_z_cat from l join g using (leaf_category)""")
def math_category_z(spark, sf):
    meta = fx.content_metadata(spark, sf).select("content_id", "leaf_category")
    prices = fx.content_price(spark, sf).groupBy("content_id").agg(F.floor(F.max("selling_price")).alias("price")).join(meta, "content_id", "left").na.fill("UNKNOWN", ["leaf_category"])
    stats = fitted.category_price(prices, "leaf_category", "price")
    return fitted.add_category_z(prices, stats, "leaf_category", "price").select("content_id", "leaf_category", F.round("price_z_cat", 7).alias("price_z_cat"))


@query("math_review_ratio", f"{views('content_price')} select content_id, update_date, coalesce(media_review_count / nullif(review_count - 1, 0), 0) as review_media_ratio from content_price")
def math_review_ratio(spark, sf):
    return fx.content_price(spark, sf).select("content_id", "update_date", rates.ratio_or(F.col("media_review_count"), F.col("review_count") - 1).alias("review_media_ratio"))


@query("bucket_tenure", f"{views('user_metadata')} select user_id, case when tenure_days % 1000 <= 30 then 'new' when tenure_days % 1000 <= 365 then 'regular' else 'loyal' end as tenure_bucket from user_metadata")
def bucket_tenure(spark, sf):
    return fx.user_metadata(spark, sf).select("user_id", rates.tenure_bucket(F.col("tenure_days") % 1000).alias("tenure_bucket"))


@query("bucket_price_rating", f"""{views("content_price")} select content_id, update_date, case when p <= 50 then 'low' when p <= 200 then 'medium' when p <= 500 then 'high' else 'premium' end as price_bucket,
    case when rate_avg >= 4.5 then 'excellent' when rate_avg >= 4.0 then 'good' when rate_avg >= 3.0 then 'average' else 'poor' end as rating_bucket
    from (select *, case when rate_count = 3 then null else original_price / 4 end as p from content_price)""")
def bucket_price_rating(spark, sf):
    price = F.when(F.col("rate_count") != 3, F.col("original_price") / 4)
    return fx.content_price(spark, sf).select("content_id", "update_date", rates.price_bucket(price).alias("price_bucket"), rates.rating_bucket(F.col("rate_avg")).alias("rating_bucket"))


@query("flag_affinity", f"""{views("sessions", "content_metadata", "user_metadata")}, o as (select user_id, sum(ordered) as orders from sessions group by 1)
    select s.session_id, s.content_id, coalesce(gender = 'BUILDING' and leaf_category in ('SMALL', 'LARGE'), false) as gender_category_match,
           coalesce((1998 - birth_year <= 30 and regexp_matches(leaf_category, 'SMALL|PROMO')) or (1998 - birth_year >= 40 and regexp_matches(leaf_category, 'LARGE|ECONOMY')), false) as age_category_match,
           coalesce(case when o.orders >= 10 then attribute_type_count * 20 <= 500 else attribute_type_count * 20 <= 200 end, false) as price_user_match
    from sessions s left join content_metadata using (content_id) left join user_metadata using (user_id) left join o using (user_id)""")
def flag_affinity(spark, sf):
    rows = fx.sessions(spark, sf)
    orders = rows.groupBy("user_id").agg(F.sum("ordered").alias("orders"))
    items, users = fx.content_metadata(spark, sf), fx.user_metadata(spark, sf)
    joined = rows.join(items, "content_id", "left").join(users, "user_id", "left").join(orders, "user_id", "left")
    leaf, age = F.col("leaf_category"), F.lit(1998) - F.col("birth_year")
    return joined.select(
        "session_id", "content_id",
        F.coalesce(affinity.gender_category(F.col("gender"), leaf, "BUILDING", ["SMALL", "LARGE"]), F.lit(False)).alias("gender_category_match"),
        F.coalesce(affinity.age_category(age, leaf, "SMALL|PROMO", "LARGE|ECONOMY"), F.lit(False)).alias("age_category_match"),
        F.coalesce(affinity.price_tolerance(F.col("attribute_type_count") * 20, F.col("orders")), F.lit(False)).alias("price_user_match"),
    )


@query("array_jaccard", f"""{views("sessions", "content_metadata")}, t as (select session_id, content_id, string_split(search_term, ' ') as a, string_split(coalesce(case when content_id % 4 = 0 then null else lower(cv_tags) end, ''), ' ') as b
      from sessions left join content_metadata using (content_id))
    select session_id, content_id, len(list_intersect(a, b))::double / len(list_distinct(a || b)) as jaccard, case when len(list_intersect(a, b)) > 0 then 1 else 0 end::bigint as any_shared from t""")
def array_jaccard(spark, sf):
    meta = fx.content_metadata(spark, sf).select("content_id", F.expr("case when content_id % 4 = 0 then null else lower(cv_tags) end").alias("tags"))
    a, b = text.tokens_by_blank(F.col("search_term")), text.tokens_by_blank(F.col("tags"))
    rows = fx.sessions(spark, sf, term=True).join(meta, "content_id", "left")
    return rows.select("session_id", "content_id", text.jaccard(a, b).alias("jaccard"), text.any_shared(a, b).alias("any_shared"))


@query("intersect_union_tokens", f"""{views("sessions", "content_metadata")}, t as (select session_id, content_id, string_split(search_term, ' ') as a, string_split(coalesce(lower(cv_tags), ''), ' ') as b from sessions left join content_metadata using (content_id))
    select session_id, content_id, array_to_string(list_sort(list_intersect(a, b)), ' ') as shared, array_to_string(list_sort(list_distinct(a || b)), ' ') as merged from t""")
def intersect_union_tokens(spark, sf):
    meta = fx.content_metadata(spark, sf).select("content_id", F.lower("cv_tags").alias("tags"))
    a, b = text.tokens_by_blank(F.col("search_term")), text.tokens_by_blank(F.col("tags"))
    rows = fx.sessions(spark, sf, term=True).join(meta, "content_id", "left")
    return rows.select(
        "session_id", "content_id", F.array_join(F.array_sort(F.array_intersect(a, b)), " ").alias("shared"), F.array_join(F.array_sort(F.array_union(a, b)), " ").alias("merged")
    )


@query("array_dedupe_ordered", r"""select doc_id, len(list_distinct(w)) as n_distinct, w[1] as first_token, array_to_string([x for x, i in w if list_position(w, x) = i], ' ') as kept
    from (select doc_id, [t for t in regexp_split_to_array(text, '[ \t\n\r\f\v]+') if t <> ''] as w from documents)""")
def array_dedupe_ordered(spark, sf):
    words = text.tokens(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", F.array_distinct(words).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_distinct"), F.try_element_at("w", F.lit(1)).alias("first_token"), F.array_join("w", " ").alias("kept"))


@query("hash_md5_bucket", f"""select p_partkey, {md5_bucket_sql("'p_brand=' || p_brand", 50_000)} as bucket from part""")
def hash_md5_bucket(spark, sf):
    return table(spark, sf, "part").select("p_partkey", hashing.md5_bucket(hashing.feature_value("p_brand", F.col("p_brand")), 50_000).alias("bucket"))


@query("hash_bucket_fast")
def hash_bucket_fast(spark, sf):
    """Buckets of the engine's own hash; other engines give other numbers."""
    return fx.content_metadata(spark, sf).select("content_id", hashing.fast_bucket(F.col("level2_category")).alias("bucket"))


@query("cast_model_input", f"""{views("content_metadata")} select content_id, case when level2_category is not null then 1 else 0 end as has_level2, coalesce(merchant_count, 0) as merchant_count, leaf_category from content_metadata""")
def cast_model_input(spark, sf):
    rows = fx.content_metadata(spark, sf).select("content_id", F.col("level2_category").isNotNull().alias("has_level2"), "merchant_count", "leaf_category")
    return encode.model_types(rows, keep=["content_id"])


@query("math_sigmoid", "select c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 9) as p from customer")
def math_sigmoid(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(rates.sigmoid(F.col("c_acctbal") / 1000), 9).alias("p"))
