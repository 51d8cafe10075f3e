"""The driver contract, and every query against its check SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as driver
from tools.check import TABLES, rows_of

@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_flagship(spark):
    assert driver.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = driver.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, [tuple(r) for r in cur.fetchall()])


@pytest.mark.parametrize("name", ["vectorize_text", "hash_bucket_fast", "feature_importance", "top_feature_importance", "holdout_group_auc", "tune_parameters"])
def test_query_without_sql_runs(spark, sf, name):
    assert driver.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["asof_enrich_all", "temporal_range_join", "search_blend_weight", "session_price_z", "join_global_scalar", "relevance_lexical"])
def test_plan_joins_on_keys_only(spark, sf, name):
    plan = driver.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_column_pruning_reaches_the_scan(spark, sf):
    plan = driver.queries()["lazy_scan_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_enrichment_scans_each_source_once(spark, sf):
    """Sessions are written once; all counters and prices of a log and key set come from one scan."""
    plan = driver.queries()["asof_enrich_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) <= 9 and sum("l_partkey" in line or "l_orderkey" in line for line in scans) <= 4


def test_enrichment_exchanges_few_times(spark, sf):
    """Rows once by session and once by item, heads once by shopper, whatever the number of logs; nothing of theirs travels back."""
    plan = driver.queries()["asof_enrich_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6


@pytest.mark.parametrize("most, narrow", [(0, 1_000_000), (0, 0)])
def test_enrichment_of_crowded_keys_is_the_same(spark, sf, monkeypatch, most, narrow):
    from sessionrank.operators import enrich, history

    wanted = driver.queries()["asof_enrich_all"](spark, sf)
    monkeypatch.setattr(history, "MOST", most)
    monkeypatch.setattr(enrich, "NARROW_ROWS", narrow)
    got = driver.queries()["asof_enrich_all"](spark, sf)
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
