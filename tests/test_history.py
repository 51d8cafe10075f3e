"""As-of joins, running counters and strictly-past joins against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionrank.operators import history
from sessionrank.operators.history import Latest, Running

H = dt.datetime(2024, 1, 1)


def at(hour, minute=0):
    return H + dt.timedelta(hours=hour, minutes=minute)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [("a", at(5), 1), ("a", at(1), 2), ("b", at(3), 3), ("c", at(3), 4), (None, at(3), 5), ("a", at(9), 6)]
    return spark.createDataFrame(rows, "k string, ts_hour timestamp_ntz, rid int")


@pytest.fixture(scope="module")
def log(spark):
    rows = [("a", at(5, 30), 1, 10.0), ("a", at(2), 2, None), ("b", at(4), 3, 5.0), (None, at(1), 9, 9.0), ("a", at(5, 10), 4, 7.0)]
    return spark.createDataFrame(rows, "k string, ts_hour timestamp_ntz, n int, price double")


def by_rid(df, *cols):
    return {r["rid"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_same_hour_counts_and_absent_keys_are_null(asked, log):
    got = by_rid(history.as_of(asked, ["k"], [Running(log, {"total": "n"})]), "total")
    assert got == {1: (7,), 2: (None,), 3: (None,), 4: (None,), 5: (None,), 6: (7,)}


def test_strict_leaves_out_the_same_hour(asked, log):
    got = by_rid(history.as_of(asked, ["k"], [Running(log, {"total": "n"})], strict=True), "total")
    assert got == {1: (2,), 2: (None,), 3: (None,), 4: (None,), 5: (None,), 6: (7,)}


def test_snapshot_is_one_row_and_ties_take_the_largest(asked, log):
    got = by_rid(history.as_of(asked, ["k"], [Latest(log, ["n", "price"])]), "n", "price")
    assert got[1] == (4, 7.0) and got[6] == (4, 7.0) and got[2] == (None, None)


def test_null_field_of_the_newest_snapshot_stays_null(spark):
    log = spark.createDataFrame([("a", at(1), 1, 3.0), ("a", at(2), 2, None)], "k string, ts_hour timestamp_ntz, n int, price double")
    left = spark.createDataFrame([("a", at(4), 1)], "k string, ts_hour timestamp_ntz, rid int")
    assert by_rid(history.as_of(left, ["k"], [Latest(log, ["n", "price"])]), "n", "price") == {1: (2, None)}


def test_several_sources_share_one_timeline(asked, log):
    df = history.as_of(asked, ["k"], [Running(log, {"total": "n"}), Latest(log, ["price"])])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert by_rid(df, "total", "price")[6] == (7, 10.0)
    assert "NestedLoop" not in plan and "SinglePartition" not in plan and "CartesianProduct" not in plan
    assert plan.count("Window [") == 1


def test_random_as_of_equals_brute_force(spark):
    rng = random.Random(7)
    # one key holds most of the rows
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice("pqr")
    logs = [(key(), at(rng.randrange(60), rng.randrange(60)), rng.randrange(5)) for _ in range(400)]
    left = [(key(), at(rng.randrange(70)), i) for i in range(300)]
    ldf = spark.createDataFrame(left, "k string, ts_hour timestamp_ntz, rid int")
    rdf = spark.createDataFrame(logs, "k string, ts_hour timestamp_ntz, n int")
    for strict in (False, True):
        got = by_rid(history.as_of(ldf, ["k"], [Running(rdf, {"total": "n"})], strict=strict), "total")
        for k, ts, rid in left:
            seen = [n for kk, t, n in logs if kk == k and (t.replace(minute=0) < ts or (not strict and t.replace(minute=0) == ts))]
            assert got[rid] == ((sum(seen) if seen else None),)


def test_multiplicity_equals_the_written_out_join(spark):
    rng = random.Random(3)
    logs = [(rng.choice("xy"), at(rng.randrange(20), rng.randrange(60)), i) for i in range(80)]
    asked = [(rng.choice("xy"), at(rng.randrange(25))) for _ in range(40)]
    log = spark.createDataFrame(logs, "k string, ts_hour timestamp_ntz, n int")
    ask = spark.createDataFrame(asked, "k string, ts_hour timestamp_ntz")
    repeats = history.past_repeats(log, ask, ["k"])
    want = {(r["n"], r["c"]) for r in repeats.groupBy("n").agg(F.count("*").alias("c")).collect()}
    got = {(r["n"], r["later_hours"]) for r in history.past_multiplicity(log, ask, ["k"]).collect()}
    assert got == want
    sums = {r["k"]: (r["rows"], r["n"]) for r in history.past_sums(log, ask, ["k"], ["n"]).collect()}
    written = {r["k"]: (r["rows"], r["n"]) for r in repeats.groupBy("k").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    assert sums == written


def test_one_log_row_three_later_hours(spark):
    log = spark.createDataFrame([("u", at(0), 5)], "k string, ts_hour timestamp_ntz, n int")
    ask = spark.createDataFrame([("u", at(h)) for h in (0, 1, 2, 3, 3)], "k string, ts_hour timestamp_ntz")
    assert history.past_multiplicity(log, ask, ["k"]).first()["later_hours"] == 3


def test_dealt_rows_find_what_timelines_find(spark):
    pick = random.Random(5)
    def some(kinds):
        return [pick.choice(k) for k in kinds]
    keys, terms = ["a", "b", "c", None], ["x", "y", None]
    left = spark.createDataFrame([(*some([keys, terms]), pick.choice([None, at(pick.randrange(30), 20)]), i) for i in range(200)] + [("a", "x", at(3), 1)], "k string, term string, ts_hour timestamp_ntz, rid int")
    site = spark.createDataFrame([(pick.choice(keys), at(pick.randrange(30), pick.randrange(60)), pick.choice([1, 2, None]), pick.choice([None, 1.0, 7.0])) for _ in range(80)], "k string, date timestamp_ntz, n int, price double")
    termed = spark.createDataFrame([(*some([keys, terms]), at(pick.randrange(30)), pick.choice([1, 5])) for _ in range(80)], "k string, term string, ts_hour timestamp_ntz, n int")
    by_key = [Latest(site, ["price", "n"], "date"), Running(site, {"total": "n", "seen": F.lit(1)}, "date"), Running(termed, {"other": "n"})]
    by_both = [Running(termed, {"pair": "n"})]
    plain = history.as_of(history.as_of(left, ["k"], by_key), ["k", "term"], by_both)
    for total in (0, 50_000_000):  # as many tasks as the session has, and more
        dealt = history.as_of_dealt(left, ["k"], [(["k"], by_key), (["k", "term"], by_both)], total=total)
        assert dealt.schema == plain.schema
        assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(dealt.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_crowding_bounds_the_rows_of_a_key(spark):
    left = spark.createDataFrame([("a",)] * 3 + [(None,)] * 5, "k string")
    assert history.crowding([left, left.where("k = 'a'")], ["k"]) == (11, 6)
    assert history.crowding([left.limit(0)], ["k"]) == (0, 0)
