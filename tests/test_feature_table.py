"""Source files in their own layout, through the whole feature table, to a submission."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionrank.operators import blend, ranking, submission
from sessionrank.plans.features import ROLES, feature_tables
from sessionrank.session import durable, output_path
from sessionrank.sources.roles import role, roles
from sessionrank.sources.tables import SOURCE_PATHS, SOURCE_SCHEMAS


def ts(day, hour=0):
    return dt.datetime(2025, 6, day, hour, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def root(spark):
    path = output_path(spark, "source")
    items = ["i1", "i2", "i3"]
    train = [(ts(10 + s, 5), "red ring", f"u{s % 2}", i, f"s{s}", int(i == "i1"), int(i == "i1" and s % 2), 0, 0) for s in range(10) for i in items]
    test = [(ts(25, 5), "red ring", "u0", i, "t0") for i in items]
    data = {
        "train_sessions": train,
        "test_sessions": test,
        "content_metadata": [(i, "a", "b", "ring", 1.0, 2.0, None, 3.0, ts(1), "red gold" if i == "i1" else None) for i in items],
        "content_price": [("i1", ts(1), 20.0, 10.0, 10.0, 1.0, 1.0, 1.0, 4.0), ("i1", ts(20), 5.0, 8.0, 8.0, 1.0, 1.0, 1.0, 4.0), ("i2", ts(1), 9.0, 9.0, 9.0, 1.0, 0.0, 1.0, 3.0)],
        "content_search_log": [("i1", ts(12), 9.0, 4.0)],
        "content_sitewide_log": [("i1", ts(11), 3.0, 1.0, 0.0, 1.0), ("i1", ts(12), 4.0, 1.0, 0.0, 0.0)],
        "content_top_terms_log": [("i1", "red ring", ts(12), 9.0, 4.0)],
        "user_metadata": [("u0", None, 1990.0, 100.0)],
        "user_search_log": [("u0", ts(12), 9.0, 4.0)],
        "user_sitewide_log": [("u0", ts(12), 9.0, 4.0, 0.0, 1.0)],
        "user_fashion_sitewide_log": [("u0", "i1", ts(11, 7), 2.0, 0.0, 0.0, 0.0), ("u0", "i1", ts(12, 7), 0.0, 0.0, 0.0, 0.0), ("u0", "i1", ts(13), 1.0, 0.0, 0.0, 0.0)],
        "term_search_log": [("red ring", ts(12), 9.0, 4.0)],
    }
    for name, rows in data.items():
        spark.createDataFrame(rows, SOURCE_SCHEMAS[name]).write.parquet(f"{path}/{SOURCE_PATHS[name]}")
    return path


def test_features_and_submission(spark, root):
    train, test = role(spark, root, "train_sessions"), role(spark, root, "test_sessions")
    done, unseen = feature_tables(train, test, roles(spark, root, ROLES))
    done = durable(done)
    rows = {(r["session_id"], r["content_id"]): r for r in done.collect()}
    assert len(rows) == 30
    first, later = rows[("s0", "i1")], rows[("s4", "i1")]
    # nothing of the future: the first session knows only the price
    assert (first["selling_price"], first["content_sw_click"], first["content_sw_order_rate"], first["user_content_past_click_count"]) == (10.0, 0.0, 0.0, 0)
    assert (later["content_sw_click"], later["content_sw_order_rate"], later["user_content_past_click_count"]) == (7.0, 2 / 8, 2)
    assert rows[("s1", "i1")]["gender"] == "UNKNOWN" and rows[("s1", "i1")]["user_age"] == -1 and first["user_age"] == 35
    assert (first["discount_percentage"], first["product_age_days"], first["hour_of_day"]) == (0.0, 24, 5)
    assert (first["user_term_freq"], first["user_term_unique_content"]) == (15, 3)
    assert first["tag_jaccard"] == pytest.approx(1 / 3) and first["tag_match"] == 1 and rows[("s0", "i2")]["tag_match"] == 0
    assert first["relevance"] > rows[("s0", "i2")]["relevance"] >= 0.5
    assert unseen.count() == 3 and "ordered" not in unseen.columns
    lists = submission.prediction_lists(unseen, F.col("relevance"))
    assert lists.first()["prediction"].split()[0] == "i1"
    assert submission.check(lists, test).first()["columns_ok"]
    scored = done.withColumns({"p_order": F.col("relevance"), "p_click": F.col("relevance")})
    assert ranking.group_auc(scored, blend.two_heads()).first()["score"] == pytest.approx(1.0)
