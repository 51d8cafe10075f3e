"""Users meet the sessions of the enrichment, not its wide rows."""

import __spark_entry__ as driver
from sessionrank import session
from sessionrank.operators import enrich


def test_wide_rows_are_not_exchanged_by_user(spark, sf, monkeypatch):
    """where users are too many to broadcast, the finished rows were exchanged once more to meet them."""
    monkeypatch.setattr(session, "NARROW_ROWS", 0)
    monkeypatch.setattr(enrich, "NARROW_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = driver.queries()["asof_enrich_all"](spark, sf)
        text = plan._jdf.queryExecution().executedPlan().toString()
        rows = plan.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange hashpartitioning(user_id" not in text and "BroadcastHashJoin" not in text
    monkeypatch.undo()
    wanted = driver.queries()["asof_enrich_all"](spark, sf)
    assert wanted.columns == plan.columns and sorted(map(repr, rows)) == sorted(map(repr, wanted.collect()))
