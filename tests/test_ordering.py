"""Hot-group paths of the ordering operators must equal the window path."""

import random

import pytest
from pyspark.sql import functions as F

from sessionrank.operators import encode, ranking, splits, submission
from sessionrank.operators.ordering import exact_quantile, key_at, rank_within, running_within


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(30)}", i, round(rng.random(), 2), rng.randrange(5)) for i in range(3000)]
    return spark.createDataFrame([(s, i, sc, int(v == 0), int(v <= 1)) for s, i, sc, v in rows], "session_id string, content_id bigint, p double, ordered int, clicked int")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("keys", [["session_id"], []])
def test_range_path_equals_window_path(skewed, keys):
    order = [F.col("p").desc(), F.col("content_id").asc()]
    sums = {"rank": F.lit(1).cast("bigint"), "hits": F.col("ordered").cast("bigint")}
    assert rows(running_within(skewed, keys, order, sums)) == rows(running_within(skewed, keys, order, sums, hot_rows=200))


def test_null_keys_survive_the_hot_path(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.lit("x")).alias("k"), "id")
    got = rank_within(df, ["k"], [F.col("id").asc()], hot_rows=10)
    assert got.count() == 100 and got.agg(F.max("rank")).first()[0] == 50


def test_metrics_do_not_depend_on_the_path(skewed):
    for fn in (
        lambda h: ranking.session_auc(skewed, "p", hot_rows=h),
        lambda h: ranking.graded_precision(skewed, "p", hot_rows=h),
        lambda h: submission.prediction_lists(skewed, "p", hot_rows=h),
        lambda h: submission.solution_lists(skewed, hot_rows=h),
        lambda h: encode.group_codes(skewed, "session_id", hot_rows=h),
        lambda h: encode.dense_codes([skewed], "content_id", hot_rows=h),
    ):
        assert rows(fn(1_000_000)) == rows(fn(20))


def test_long_lists_are_put_together_in_order(skewed, monkeypatch):
    want = rows(submission.prediction_lists(skewed, "p")), rows(submission.solution_lists(skewed))
    monkeypatch.setattr(submission, "PIECE", 7)
    assert (rows(submission.prediction_lists(skewed, "p")), rows(submission.solution_lists(skewed))) == want


def test_key_at_every_kind_of_position(spark):
    rng = random.Random(5)
    # one value holds a third of the rows
    values = [(rng.choice(["m", "m", f"v{rng.randrange(200)}"]), rng.randrange(50)) for _ in range(2000)]
    df = spark.createDataFrame(values, "a string, b int")
    ordered = sorted(values)
    for position in (0, 1, 700, 1000, 1999):
        assert key_at(df, ["a", "b"], position, small_rows=20) == ordered[position]
    with pytest.raises(ValueError):
        key_at(df, ["a", "b"], 2000)


def test_exact_quantile(spark):
    values = [float(v) for v in [5, 1, 1, 1, 9, 2]] * 50
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert exact_quantile(df, "v", 0.5, small_rows=10) == 1.5
    assert exact_quantile(df.where("v is null"), "v", 0.5) is None


def test_split_boundary_inside_one_hour(spark):
    df = spark.range(100).select(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts_hour"), (F.col("id") % 7).alias("session_id"), F.col("id").alias("content_id")
    )
    for small in (200_000, 5):
        train, val = splits.time_split(df, small_rows=small)
        assert (train.count(), val.count()) == (85, 15)
        last = train.agg(F.max(F.struct("ts_hour", "session_id", "content_id"))).first()[0]
        first = val.agg(F.min(F.struct("ts_hour", "session_id", "content_id"))).first()[0]
        assert tuple(last) < tuple(first)
    parts = splits.three_way(df, small_rows=5)
    assert {k: v.count() for k, v in parts.items()} == {"test": 5, "train": 80, "val": 15}


def test_split_is_a_filter_without_exchange(spark):
    df = spark.range(100).select(F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("ts_hour"), F.col("id").alias("session_id"), F.col("id").alias("content_id"))
    train, _ = splits.time_split(df)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("small_rows", [3, 200_000])
def test_weighted_positions_equal_a_repeated_list(spark, small_rows):
    """Several positions in the same passes, with ties, weights of 0 and values that hold most of the weight."""
    import random

    from sessionrank.operators.ordering import weighted_quantile, weighted_values_at

    pick = random.Random(small_rows)
    rows = [(float(pick.randrange(-40, 40)), pick.choice([0, 1, 2, 50])) for _ in range(400)] + [(7.0, 5000)]
    df = spark.createDataFrame(rows, "v double, w bigint").repartition(3)
    listed = sorted(v for v, w in rows for _ in range(w))
    positions = [0, 1, len(listed) - 1, len(listed) // 2, len(listed) // 2, 17, 900]
    assert weighted_values_at(df, "v", "w", positions, small_rows) == [listed[p] for p in positions]
    for q in (0.0, 0.31, 0.5, 1.0):
        at = q * (len(listed) - 1)
        a, b = listed[int(at)], listed[min(int(at) + 1, len(listed) - 1)]
        assert weighted_quantile(df, "v", "w", q, small_rows) == pytest.approx(a + (b - a) * (at - int(at)))
    assert weighted_quantile(df.where("w < 0"), "v", "w", 0.5) is None
    with pytest.raises(ValueError):
        weighted_values_at(df, "v", "w", [len(listed)], small_rows)
