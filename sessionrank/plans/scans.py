"""Sources and sinks on the driver tables. Sinks write to fresh paths below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionrank.operators import blend, profile, submission
from sessionrank.plans.aggregates import PROFILED, _profile_sql
from sessionrank.plans.registry import query, views
from sessionrank.session import output_path
from sessionrank.sources import fixtures as fx
from sessionrank.sources import sinks, tables

TABLES = list(PROFILED)


@query("scan_projected", "select l_orderkey, l_partkey, l_quantity from lineitem")
def scan_projected(spark, sf):
    return tables.read_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@query("source_catalog", " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, cast({len(c)} as bigint) as n_columns from {t}" for t, c in PROFILED.items()))
def source_catalog(spark, sf):
    found = tables.row_counts(spark, {t: f"{sf}/{t}.parquet" for t in [*TABLES, "absent_table"]})
    return spark.createDataFrame([tuple(r) for r in found.collect()], found.schema)  # a row a table


@query("lazy_scan_filter", "select o_orderkey, o_custkey, o_orderdate from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01'")
def lazy_scan_filter(spark, sf):
    year = (F.col("o_orderdate") >= F.expr("timestamp_ntz '1998-01-01 00:00:00'")) & (F.col("o_orderdate") < F.expr("timestamp_ntz '1999-01-01 00:00:00'"))
    return tables.read_slice(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate"], year)


@query("sink_parquet", f"{views('sessions')} select session_id, content_id, ts_hour, p_order, year(ts_hour)::integer as year from sessions")
def sink_parquet(spark, sf):
    rows = fx.sessions(spark, sf).select("session_id", "content_id", "ts_hour", "p_order", F.year("ts_hour").alias("year"))
    return sinks.to_parquet(rows, output_path(spark, "sessions"), ["year"])


LIST_SQL = f"""{views('sessions')} select session_id, string_agg(cast(content_id as varchar), ' ' order by {{order}}content_id) as prediction from sessions group by 1"""


@query("sink_submission_csv", LIST_SQL.format(order="p_order desc, "))
def sink_submission_csv(spark, sf):
    return sinks.to_csv(submission.prediction_lists(fx.sessions(spark, sf), "p_order"), output_path(spark, "submission"))


@query("scan_csv", LIST_SQL.format(order="p_click desc, "))
def scan_csv(spark, sf):
    path = output_path(spark, "sample")
    submission.prediction_lists(fx.sessions(spark, sf), "p_click").write.option("header", True).csv(path)
    return tables.read_ranked_csv(spark, path, "bigint")


@query("sink_json_lines", f"{views('sessions')} select ordered, clicked, count(*) as n, round(avg({blend.FINAL_WEIGHT}::double * p_order + (1::double - {blend.FINAL_WEIGHT}::double) * p_click), 9) as mean_score from sessions group by all")
def sink_json_lines(spark, sf):
    rows = fx.sessions(spark, sf).groupBy("ordered", "clicked").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(blend.two_heads()), 9).alias("mean_score"))
    return sinks.to_json_lines(rows, output_path(spark, "records"))


@query("sink_profile_report", _profile_sql())
def sink_profile_report(spark, sf):
    found = profile.profiles({name: tables.table(spark, sf, name) for name in PROFILED})
    return sinks.to_csv(found, output_path(spark, "profile"))
