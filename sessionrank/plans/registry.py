"""The query register and the check SQL of the fixture views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where SQL can."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Fixture views for the check SQL. Order matters: later ones may use earlier ones.
VIEWS = {
    "sessions": """
        select a.session_id, a.content_id, o.o_custkey as user_id, date_trunc('hour', o.o_orderdate) as ts_hour,
               t.search_term, a.ordered, a.clicked, a.p_order, a.p_click
        from (select l_orderkey as session_id, l_partkey as content_id,
                     max(case when l_returnflag = 'R' and l_linestatus = 'F' then 1 else 0 end) as ordered,
                     max(case when l_returnflag = 'R' then 1 else 0 end) as clicked,
                     max(l_discount) as p_order, max(l_tax) as p_click
              from lineitem group by 1, 2) a
        join orders o on o.o_orderkey = a.session_id
        join (select l_orderkey, lower(min(p_name)) as search_term
              from lineitem join part on p_partkey = l_partkey group by 1) t on t.l_orderkey = a.session_id""",
    "content_metadata": """
        select p_partkey as content_id, p_brand as level1_category, nullif(p_brand, 'Brand#1') as level2_category,
               p_type as leaf_category, p_name as cv_tags, cast(p_size as double) as attribute_type_count,
               cast(p_size * 2 as double) as total_attribute_option_count,
               cast(nullif(p_size % 7, 0) as double) as merchant_count,
               cast(p_size % 5 as double) as filterable_label_count,
               timestamp '1995-01-01 00:00:00' + to_days(cast(p_size as integer)) as creation_date
        from part""",
    "content_price": """
        select l_partkey as content_id, l_shipdate as update_date,
               (l_extendedprice / l_quantity) * (cast(1 as double) - l_discount) as selling_price,
               l_extendedprice / l_quantity as original_price,
               l_quantity as review_count, floor(l_quantity / 3) as media_review_count,
               cast(l_linenumber as double) as rate_count, cast(1 as double) + l_tax * 50 as rate_avg
        from lineitem""",
    "content_sitewide_log": """
        select l_partkey as content_id, l_shipdate as date, l_quantity as click,
               case when l_linestatus = 'O' then 1 else 0 end as cart,
               case when l_returnflag = 'A' then 1 else 0 end as fav, 1 as orders
        from lineitem""",
    "content_search_log": """
        select l_partkey as content_id, l_shipdate as date, l_quantity as impression, 1 as click from lineitem""",
    "content_top_terms_log": """
        select l_partkey as content_id, lower(p_name) as search_term, l_shipdate as date, l_quantity as impression, 1 as click
        from lineitem join part on p_partkey = l_partkey""",
    "term_search_log": """
        select lower(p_name) as search_term, l_shipdate as ts_hour, l_quantity as impression, 1 as click
        from lineitem join part on p_partkey = l_partkey""",
    "user_metadata": """
        select c_custkey as user_id, nullif(c_mktsegment, 'MACHINERY') as gender, 1950 + c_custkey % 50 as birth_year,
               cast(trunc(abs(c_acctbal)) as bigint) as tenure_days
        from customer""",
    "shopper_sitewide_log": """
        select o_custkey as user_id, l_shipdate as ts_hour, l_quantity as click,
               case when l_linestatus = 'O' then 1 else 0 end as cart,
               case when l_returnflag = 'A' then 1 else 0 end as fav, 1 as orders
        from lineitem join orders on o_orderkey = l_orderkey""",
    "shopper_search_log": """
        select o_custkey as user_id, l_shipdate as ts_hour, l_quantity as impression, 1 as click
        from lineitem join orders on o_orderkey = l_orderkey""",
    "shopper_top_terms_log": """
        select o_custkey as user_id, lower(p_name) as search_term, l_shipdate as ts_hour, l_quantity as impression, 1 as click
        from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey""",
    "user_content_log": """
        select o_custkey as user_id, l_suppkey as content_id, l_shipdate as ts_hour,
               case when l_quantity > 25 then l_quantity else cast(0 as double) end as total_click
        from lineitem join orders on o_orderkey = l_orderkey""",
    "supplier_sessions": """
        select distinct l_orderkey as session_id, o_custkey as user_id, l_suppkey as content_id,
               date_trunc('hour', o_orderdate) as ts_hour
        from lineitem join orders on o_orderkey = l_orderkey""",
    "event_sitewide_log": """
        select user_id, ts as ts_hour, case when event_type = 'click' then 1 else 0 end as click,
               case when event_type = 'view' then 1 else 0 end as cart,
               case when event_type = 'signup' then 1 else 0 end as fav,
               case when event_type = 'purchase' then 1 else 0 end as orders
        from events""",
    "event_search_log": """
        select user_id, ts as ts_hour, case when event_type = 'view' then 1 else 0 end as impression,
               case when event_type = 'click' then 1 else 0 end as click
        from events""",
    "event_sessions": """
        select distinct user_id, date_trunc('hour', ts) as ts_hour from events where event_type = 'purchase'""",
}


def views(*names: str) -> str:
    """A WITH clause of fixture views, to be followed by a select or more views."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)


def md5_bucket_sql(text: str, buckets: int) -> str:
    """The MD5 digest of a text as a number modulo ``buckets``, for the check engine."""
    powers = ["79228162514264337593543950336", "18446744073709551616", "4294967296", "1"]
    terms = [f"('0x' || substr(md5({text}), {8 * i + 1}, 8))::uhugeint * {p}::uhugeint" for i, p in enumerate(powers)]
    return f"cast(({' + '.join(terms)}) % {buckets}::uhugeint as bigint)"
