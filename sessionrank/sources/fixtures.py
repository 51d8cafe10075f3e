"""The driver tables in the roles of the ranking data set: sessions, logs, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrank.functions.dates import floor_hour
from sessionrank.operators.history import MOST, crowding
from sessionrank.session import narrow
from sessionrank.sources.tables import table


def _flag(condition):
    return F.when(condition, 1).otherwise(0)


def sessions(spark: SparkSession, sf: str, term: bool = False) -> DataFrame:
    """One row per (session, item); repeated pairs keep the best score and label.

    ``term`` adds the session's search term, its first item name.
    """
    joined = session_items(spark, sf).join(_orders(spark, sf), "session_id").select(
        "session_id", "content_id", "user_id", "ts_hour", "ordered", "clicked", "p_order", "p_click"
    )
    return joined.join(_terms(spark, sf), "session_id") if term else joined


def session_items(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """The items of the sessions with scores and labels, without what belongs to a session as a whole.

    ``dealt`` exchanges the lines once, by session, for this and for a join on the session that
    follows, unless sessions are too large for that.
    """
    line = table(spark, sf, "lineitem")
    crowded = dealt and crowding([line], ["l_orderkey"])[1] > MOST
    line = line.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("content_id"),
        _flag((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("ordered"), _flag(F.col("l_returnflag") == "R").alias("clicked"),
        F.col("l_discount").alias("p_order"), F.col("l_tax").alias("p_click"),
    )
    if dealt and not crowded:
        line = line.repartition("session_id")
    return line.groupBy("session_id", "content_id").agg(*[F.max(c).alias(c) for c in ("ordered", "clicked", "p_order", "p_click")])


def session_hours(spark: SparkSession, sf: str) -> DataFrame:
    """User and hour of the sessions."""
    return _orders(spark, sf)


def session_heads(spark: SparkSession, sf: str) -> DataFrame:
    """User, hour and search term of the sessions."""
    return _orders(spark, sf).join(_terms(spark, sf), "session_id")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), floor_hour("o_orderdate").alias("ts_hour")
    )


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), "l_partkey")
    return lines.join(narrow(part), "l_partkey").groupBy("session_id").agg(F.lower(F.min("p_name")).alias("search_term"))


def content_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("content_id"),
        F.col("p_brand").alias("level1_category"),
        F.expr("nullif(p_brand, 'Brand#1')").alias("level2_category"),
        F.col("p_type").alias("leaf_category"),
        F.col("p_name").alias("cv_tags"),
        F.expr("cast(p_size as double)").alias("attribute_type_count"),
        F.expr("cast(p_size * 2 as double)").alias("total_attribute_option_count"),
        F.expr("cast(nullif(p_size % 7, 0) as double)").alias("merchant_count"),
        F.expr("cast(p_size % 5 as double)").alias("filterable_label_count"),
        F.expr("timestamp_ntz '1995-01-01 00:00:00' + make_interval(0, 0, 0, p_size)").alias("creation_date"),
    )


def content_price(spark: SparkSession, sf: str) -> DataFrame:
    """Price snapshots; several may share one (item, day)."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("content_id"), F.col("l_shipdate").alias("update_date"), *_prices())


def content_sitewide_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("content_id"), F.col("l_shipdate").alias("date"), *_site())


def content_search_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("content_id"), F.col("l_shipdate").alias("date"), *_search())


def item_log(spark: SparkSession, sf: str) -> DataFrame:
    """Prices, site counters and search counters of items in one frame, so that one scan feeds them all."""
    counters = [*_site(), F.col("l_quantity").alias("impression"), F.lit(1).alias("search_click")]
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("content_id"), F.col("l_shipdate").alias("date"), *counters, *_prices())


def content_top_terms_log(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("content_id"), F.lower("p_name").alias("search_term"))
    return content_search_log(spark, sf).join(narrow(part), "content_id")


def term_search_log(spark: SparkSession, sf: str) -> DataFrame:
    return content_top_terms_log(spark, sf).select("search_term", F.col("date").alias("ts_hour"), "impression", "click")


def user_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("gender"),
        F.expr("1950 + c_custkey % 50").alias("birth_year"),
        F.expr("cast(abs(c_acctbal) as bigint)").alias("tenure_days"),
    )


def _lines_of_users(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), "o_orderdate")
    return table(spark, sf, "lineitem").join(orders, "l_orderkey")


def shopper_sitewide_log(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_of_users(spark, sf).select("user_id", F.col("l_shipdate").alias("ts_hour"), *_site())


def shopper_search_log(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_of_users(spark, sf).select("user_id", F.col("l_shipdate").alias("ts_hour"), *_search())


def shopper_log(spark: SparkSession, sf: str) -> DataFrame:
    """Site and search counters of users in one frame."""
    counters = [*_site(), F.col("l_quantity").alias("impression"), F.lit(1).alias("search_click")]
    return _lines_of_users(spark, sf).select("user_id", F.col("l_shipdate").alias("ts_hour"), *counters)


def shopper_top_terms_log(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("search_term"))
    return _lines_of_users(spark, sf).join(part, "l_partkey").select(
        "user_id", "search_term", F.col("l_shipdate").alias("ts_hour"), *_search()
    )


def user_content_log(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks of a user on a supplier, the item role in which pairs repeat."""
    return _lines_of_users(spark, sf).select(
        "user_id",
        F.col("l_suppkey").alias("content_id"),
        F.col("l_shipdate").alias("ts_hour"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0).alias("total_click"),
    )


def supplier_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_of_users(spark, sf).select(
        F.col("l_orderkey").alias("session_id"), "user_id", F.col("l_suppkey").alias("content_id"), floor_hour("o_orderdate").alias("ts_hour")
    ).distinct()


def event_sitewide_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "user_id",
        F.col("ts").alias("ts_hour"),
        _flag(kind == "click").alias("click"),
        _flag(kind == "view").alias("cart"),
        _flag(kind == "signup").alias("fav"),
        _flag(kind == "purchase").alias("orders"),
    )


def event_search_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "user_id", F.col("ts").alias("ts_hour"), _flag(kind == "view").alias("impression"), _flag(kind == "click").alias("click")
    )


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The hours at which a user bought something."""
    return table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", floor_hour("ts").alias("ts_hour")).distinct()


def _site():
    return [
        F.col("l_quantity").alias("click"),
        _flag(F.col("l_linestatus") == "O").alias("cart"),
        _flag(F.col("l_returnflag") == "A").alias("fav"),
        F.lit(1).alias("orders"),
    ]


def _search():
    return [F.col("l_quantity").alias("impression"), F.lit(1).alias("click")]


def _prices():
    original = F.col("l_extendedprice") / F.col("l_quantity")
    return [
        (original * (F.lit(1.0) - F.col("l_discount"))).alias("selling_price"),
        original.alias("original_price"),
        F.col("l_quantity").alias("review_count"),
        F.floor(F.col("l_quantity") / 3).cast("double").alias("media_review_count"),
        F.col("l_linenumber").cast("double").alias("rate_count"),
        (F.lit(1.0) + F.col("l_tax") * 50).alias("rate_avg"),
    ]
