"""Labels, codes, scaling, vectors and text relevance on the driver tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionrank.models import heads
from sessionrank.operators import encode, relevance, splits
from sessionrank.plans.registry import md5_bucket_sql, query, views
from sessionrank.sources import fixtures as fx


@query("label_any_positive", f"{views('sessions')} select session_id, content_id, case when ordered = 1 or clicked = 1 then 1 else 0 end as target from sessions")
def label_any_positive(spark, sf):
    return fx.sessions(spark, sf).select("session_id", "content_id", encode.any_positive().alias("target"))


@query("label_graded_integer", f"{views('sessions')} select session_id, content_id, cast(2 * ordered + clicked as bigint) as relevance from sessions")
def label_graded_integer(spark, sf):
    return fx.sessions(spark, sf).select("session_id", "content_id", encode.graded().alias("relevance"))


@query("label_graded_weighted", f"""{views('sessions')} select session_id, content_id, round((0.7::double * ordered + 0.3::double * clicked) / 1.0::double, 9) as relevance,
    round((3 * ordered + clicked) / 4.0::double, 9) as relevance_3_1 from sessions""")
def label_graded_weighted(spark, sf):
    return fx.sessions(spark, sf).select(
        "session_id", "content_id", F.round(encode.weighted_relevance(-1.0, 0.0), 9).alias("relevance"), F.round(encode.weighted_relevance(3.0, 1.0), 9).alias("relevance_3_1")
    )


@query("sample_weights", f"""{views('sessions')}, t as (select sum(1 - greatest(ordered, clicked))::double / sum(greatest(ordered, clicked))::double as ratio from sessions)
    select session_id, content_id, round(case when ordered = 1 or clicked = 1 then ratio * (0.7::double * ordered + 0.3::double * clicked) else 1 end, 9) as weight from sessions, t""")
def sample_weights(spark, sf):
    return encode.add_sample_weights(fx.sessions(spark, sf)).select("session_id", "content_id", F.round("weight", 9).alias("weight"))


def _with_meta(spark, sf):
    """Sessions with item attributes; items the metadata does not know keep their rows."""
    return fx.sessions(spark, sf).join(fx.content_metadata(spark, sf), "content_id", "left")


@query("encode_train_categories", f"""{views("sessions", "content_metadata")},
    r as (select s.*, level2_category, cv_tags, row_number() over (order by ts_hour nulls first, session_id, s.content_id) as place, count(*) over () as total
          from sessions s left join content_metadata m on m.content_id = s.content_id),
    tr as (select * from r where place <= trunc(total * 0.85::double)),
    a as (select level2_category, dense_rank() over (order by level2_category) as code from (select distinct level2_category from tr where level2_category is not null)),
    b as (select cv_tags, dense_rank() over (order by cv_tags) as code from (select distinct cv_tags from tr where cv_tags is not null))
    select session_id, content_id, coalesce(a.code, 0) as level2_category_code, coalesce(b.code, 0) as cv_tags_code from r left join a using (level2_category) left join b using (cv_tags)""")
def encode_train_categories(spark, sf):
    """Codes from the first 85 % of the rows by time; what only the rest has is unseen."""
    rows = _with_meta(spark, sf)
    train, _ = splits.time_split(rows)
    coded = encode.encode_train(train, rows, ["level2_category", "cv_tags"])
    return coded.select("session_id", "content_id", "level2_category_code", "cv_tags_code")


@query("encode_union_labels", f"""{views("user_metadata")}, u as (select user_id, coalesce(gender, 'unknown') as gender from user_metadata)
    select user_id, gender, dense_rank() over (order by gender) - 1 as gender_label from u""")
def encode_union_labels(spark, sf):
    rows = fx.user_metadata(spark, sf).select("user_id", "gender")
    train, test = encode.encode_union(rows.where("user_id % 2 = 0"), rows.where("user_id % 2 = 1"), ["gender"])
    return train.unionByName(test)


@query("scale_minmax", f"""{views("user_metadata")}, f as (select min(tenure_days)::double as lo, max(tenure_days)::double as hi from user_metadata where user_id % 2 = 0)
    select user_id, (tenure_days - lo) / (hi - lo) as tenure_days from user_metadata, f""")
def scale_minmax(spark, sf):
    rows = fx.user_metadata(spark, sf).select("user_id", "tenure_days")
    return encode.scale_minmax(rows.where("user_id % 2 = 0"), rows, ["tenure_days"])


@query("scale_standard", f"""{views("user_metadata")}, u as (select user_id, nullif(birth_year, 1970) as birth_year, tenure_days from user_metadata),
    f as (select avg(birth_year) as m1, stddev_pop(birth_year) as s1, avg(tenure_days) as m2, stddev_pop(tenure_days) as s2 from u where user_id % 2 = 0)
    select user_id, round((coalesce(birth_year, m1) - m1) / s1, 8) as birth_year, round((tenure_days - m2) / s2, 8) as tenure_days from u, f""")
def scale_standard(spark, sf):
    rows = fx.user_metadata(spark, sf).select("user_id", F.expr("nullif(birth_year, 1970)").alias("birth_year"), "tenure_days")
    scaled = encode.scale_standard(rows.where("user_id % 2 = 0"), rows, ["birth_year", "tenure_days"])
    return scaled.select("user_id", F.round("birth_year", 8).alias("birth_year"), F.round("tenure_days", 8).alias("tenure_days"))


VECTOR = ["attribute_type_count", "filterable_label_count", "merchant_count"]


@query("assemble_vectors", f"""{views("content_metadata")} select content_id, 3 as n_features, attribute_type_count as f0, filterable_label_count as f1, coalesce(merchant_count, 0) as f2 from content_metadata""")
def assemble_vectors(spark, sf):
    rows = encode.model_types(fx.content_metadata(spark, sf).select("content_id", *VECTOR), keep=["content_id"])
    vectors = heads.assembler(VECTOR).transform(rows).select("content_id", vector_to_array("features").alias("v"))
    return vectors.select("content_id", F.size("v").alias("n_features"), *[F.col("v")[i].alias(f"f{i}") for i in range(3)])


WIDE = ["level2_category", "leaf_category", "cv_tags"]
WIDE_SQL = ", ".join(f"""{md5_bucket_sql(f"'{c}=' || coalesce({c}, 'MISSING')", 1 << 18)} as bucket_{i}""" for i, c in enumerate(WIDE))


@query("hash_wide_features", f"""{views("sessions", "content_metadata")}, h as (select content_id, {WIDE_SQL} from content_metadata)
    select session_id, content_id, bucket_0, bucket_1, bucket_2 from sessions join h using (content_id)""")
def hash_wide_features(spark, sf):
    # hashed once per item, not once per session row
    items = fx.content_metadata(spark, sf).select("content_id", encode.wide_buckets(WIDE, 1 << 18).alias("b"))
    rows = fx.sessions(spark, sf).join(items, "content_id")
    return rows.select("session_id", "content_id", *[F.col("b")[i].alias(f"bucket_{i}") for i in range(len(WIDE))])


@query("relevance_lexical", f"""{views("sessions", "content_metadata")},
    d as (select content_id, string_split(lower(leaf_category || ' ' || cv_tags || ' ' || level1_category), ' ') as w from content_metadata),
    p as (select content_id, token, len(any_value(w)) as dl, count(*) as tf from (select content_id, w, unnest(w) as token from d) group by 1, 2),
    df as (select token, count(*) as df from p group by 1), n as (select count(*)::double as n, avg(len(w)) as avgdl from d),
    wt as (select content_id, token, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as wt from p join df using (token), n),
    q as (select session_id, content_id, unnest(list_distinct(string_split(search_term, ' '))) as token from sessions),
    s as (select session_id, content_id, sum(wt) as r from q join wt using (content_id, token) group by 1, 2)
    select session_id, content_id, round(coalesce(r, 0), 8) as relevance from sessions left join s using (session_id, content_id)""")
def relevance_lexical(spark, sf):
    text = F.concat_ws(" ", "leaf_category", "cv_tags", "level1_category")
    documents = fx.content_metadata(spark, sf).select("content_id", text.alias("product_text"))
    scored = relevance.bm25(fx.sessions(spark, sf, term=True), documents)
    return scored.select("session_id", "content_id", F.round("relevance", 8).alias("relevance"))


@query("udf_batch_scorer", f"""{views("sessions", "content_metadata")}, t as (select session_id, content_id, list_distinct(string_split(search_term, ' ')) as q, string_split(lower(cv_tags), ' ') as d
      from sessions join content_metadata using (content_id))
    select session_id, content_id, len(list_intersect(q, d))::double / len(q) as score from t""")
def udf_batch_scorer(spark, sf):
    tags = fx.content_metadata(spark, sf).select("content_id", F.col("cv_tags").alias("text"))
    pairs = fx.sessions(spark, sf, term=True).join(tags, "content_id").select("session_id", "content_id", F.col("search_term").alias("query"), "text")
    return relevance.score_pairs(pairs).select("session_id", "content_id", "score")
