"""No row is lost: streams over several files in any order, splits with missing hours."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionrank.operators import splits
from sessionrank.streaming import hourly


def test_stream_counts_all_files_whatever_their_order(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for name, hours in (("a", [100] * 5), ("b", [1, 2] * 5), ("c", [50] * 5)):
        rows = [(start + dt.timedelta(hours=h),) for h in hours]
        spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))
    path = str(tmp_path / "in" / "*")
    batch = spark.read.parquet(path)
    want = {tuple(r) for r in batch.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz")).count().collect()}
    for per_trigger in (1, 1000):
        stream = hourly.file_stream(spark, path, batch, per_trigger)
        got = hourly.run_available(stream, "test_counts", "ts", [], {"n": F.count(F.lit(1))})
        assert {tuple(r) for r in got.select("ts_hour", "n").collect()} == want


@pytest.mark.parametrize("missing", [100, 900])
@pytest.mark.parametrize("small_rows", [8, 200_000])
def test_split_keeps_rows_without_an_hour(spark, missing, small_rows):
    hour = F.when(F.col("id") >= missing, F.timestamp_add("HOUR", (F.col("id") % 37).cast("int"), F.lit("2024-01-01").cast("timestamp"))).cast("timestamp_ntz")
    df = spark.range(1000).select(hour.alias("ts_hour"), F.col("id").alias("session_id"), F.lit(1).alias("content_id"))
    head, tail = splits.time_split(df, small_rows=small_rows)
    assert (head.count(), tail.count()) == (850, 150)
    assert tail.where("ts_hour is null").count() == max(0, missing - 850)
    parts = splits.three_way(df, small_rows=small_rows)
    assert {k: v.count() for k, v in parts.items()} == {"test": 50, "train": 800, "val": 150}


@pytest.mark.parametrize("small_rows", [5, 200_000])
def test_splits_by_hour_counts_equal_a_sort(spark, small_rows):
    """Times inside hours, ties, rows without a time, dates before 1970 and a very full hour."""
    import random

    pick = random.Random(small_rows)
    start = dt.datetime(1969, 12, 31, 22)
    times = [None if pick.random() < 0.1 else start + dt.timedelta(minutes=pick.choice([0, 0, 10, 59, 60, 61, 500, 4000])) for _ in range(300)]
    rows = [(t, pick.randrange(20), i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "ts_hour timestamp_ntz, session_id bigint, content_id bigint").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or start, r[1], r[2]))
    head, tail = splits.time_split(df, small_rows=small_rows)
    assert sorted(r[2] for r in head.collect()) == sorted(r[2] for r in order[:255]) and tail.count() == 45
    parts = splits.three_way(df, small_rows=small_rows)
    for name, want in (("test", order[:15]), ("train", order[15:255]), ("val", order[255:])):
        assert sorted(r[2] for r in parts[name].collect()) == sorted(r[2] for r in want)
    known = sorted(t for t in times if t is not None)
    assert splits.cutoffs(df, small_rows=small_rows) == (known[int(len(known) * 0.05)], known[int(len(known) * 0.85)])


def test_split_makes_two_passes_and_keeps_nothing(spark, sf):
    """One job counts the hours, one reads the rows of the boundary hour; nothing is held on the executors."""
    from sessionrank.sources import fixtures

    df = fixtures.sessions(spark, sf).select("ts_hour", "session_id", "content_id")
    head, tail = splits.time_split(df)
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Sort" not in plan.replace("SortMerge", "")
    assert head.count() == int(df.count() * 0.85)


def test_event_time_windows_and_late_rows(spark, tmp_path):
    """Three files, early, in time and late: open hours take rows in any order, closed ones send theirs to the side output."""
    import os
    import time

    start = dt.datetime(2024, 1, 1)
    files = [[(1, "a"), (1, "b"), (10, "a")], [(9, "a"), (10, "b"), (30, "a")], [(2, "a"), (10, "b"), (27, "b"), (31, "a")], [(8, "b"), (40, "a")]]
    for i, rows in enumerate(files):
        path = tmp_path / f"f{i}"
        spark.createDataFrame([(start + dt.timedelta(hours=h, minutes=7), k) for h, k in rows], "ts timestamp_ntz, k string").coalesce(1).write.parquet(str(path))
        for part in path.glob("*.parquet"):
            os.utime(part, (time.time() - 1000 + i * 10,) * 2)
    like = spark.read.parquet(str(tmp_path / "*"))
    stream = hourly.file_stream(spark, str(tmp_path / "*"), like, 1)
    counted, late = hourly.run_windows(stream, "test_windows", "ts", ["k"], {"n": F.count(F.lit(1))}, dt.timedelta(hours=5))
    want, lost = {}, []
    for i, rows in enumerate(files):
        # the watermark lies five hours before the greatest time of the files but this and the one before
        top = max((h for f in files[: max(0, i - 1)] for h, _ in f), default=None)
        for h, k in rows:
            if top is not None and h + 1 <= top + 7 / 60 - 5:
                lost.append((start + dt.timedelta(hours=h, minutes=7), k))
            else:
                want[k, start + dt.timedelta(hours=h)] = want.get((k, start + dt.timedelta(hours=h)), 0) + 1
    assert {(r.k, r.ts_hour): r.n for r in counted.collect()} == want
    assert sorted(tuple(r) for r in late.collect()) == sorted(lost) and len(lost) == 2
    assert sum(want.values()) + len(lost) == like.count()


def test_streams_without_a_file(spark, tmp_path):
    (tmp_path / "none").mkdir()
    like = spark.createDataFrame([], "ts timestamp_ntz, k string")
    stream = hourly.file_stream(spark, str(tmp_path / "none"), like)
    assert hourly.run_available(stream, "none", "ts", ["k"], {"n": F.count(F.lit(1))}).count() == 0
    counted, late = hourly.run_windows(stream, "none", "ts", ["k"], {"n": F.count(F.lit(1))}, dt.timedelta(hours=1))
    assert counted.count() == 0 and late.count() == 0
