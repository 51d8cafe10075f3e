"""Edge cases of expressions, fills, fitted statistics, encodings, profiles and relevance."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sessionrank.functions import affinity, dates, hashing, rates, text
from sessionrank.operators import aggregates, clean, encode, fitted, profile, relevance


def one(spark, expr, **cells):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]) if cells else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_rates(spark):
    assert one(spark, rates.smoothed(F.lit(0.0), F.lit(0.0))) == 1.0
    assert one(spark, rates.ratio_or(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, rates.num(F.lit("x1"))) is None
    for o, s, want in ((5.0, 8.0, 0.0), (0.0, 0.0, 0.0), (None, 3.0, 0.0), (10.0, 7.5, 25.0)):
        assert one(spark, rates.discount_pct(F.lit(o).cast("double"), F.lit(s))) == want


def test_calendar(spark):
    friday, saturday, monday = (dt.datetime(2024, 1, d, 5) for d in (5, 6, 8))
    day = lambda d: F.lit(str(d)).cast("timestamp_ntz")
    assert [one(spark, dates.is_weekend(day(d))) for d in (friday, saturday, monday)] == [True, True, False]
    periods = [one(spark, dates.time_period(day(dt.datetime(2024, 1, 8, h)))) for h in (5, 6, 12, 13, 18, 19, 23)]
    assert periods == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]
    assert one(spark, dates.whole_days_between(day("2024-01-01 12:00:00"), day("2024-01-02 11:00:00"))) == 0
    assert one(spark, dates.parse_hour(F.lit("no time"))) is None


def test_tokens_and_jaccard(spark):
    blank = text.tokens_by_blank(F.lit(""))
    assert one(spark, text.jaccard(blank, blank)) == 1.0
    assert one(spark, text.any_shared(blank, blank)) == 1
    a, b = (text.tokens_by_blank(F.lit(v)) for v in ("x y x", "x z"))
    assert one(spark, text.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, text.tokens(F.lit("  a \t b  "))) == ["a", "b"]
    assert [one(spark, text.normalize_term(F.lit(v).cast("string"))) for v in (" Ab ", "None", None)] == ["ab", "", ""]


def test_md5_bucket_is_the_digest_modulo(spark):
    for value, buckets in (("p_brand=Brand#2", 50_000), ("x=", 97), ("ü=é", 1 << 18)):
        want = int(hashlib.md5(value.encode()).hexdigest(), 16) % buckets
        assert one(spark, hashing.md5_bucket(F.lit(value), buckets)) == want
    assert int(hashlib.md5(b"p_brand=Brand#2").hexdigest(), 16) % 50_000 == 29129


def test_affinity_flags(spark):
    assert one(spark, affinity.gender_category(F.lit("Bayan"), F.lit("Giyim"))) is True
    assert one(spark, affinity.age_category(F.lit(None).cast("int"), F.lit("Casual"))) is False
    assert one(spark, affinity.price_tolerance(F.lit(300.0), F.lit(10))) is True
    assert one(spark, affinity.price_tolerance(F.lit(300.0), F.lit(None).cast("int"))) is False


def test_session_price(spark):
    rows = [("one", 5.0), ("same", 3.0), ("same", 3.0), ("gap", None), ("gap", 2.0), ("gap", 4.0)]
    df = fitted.session_price(spark.createDataFrame(rows, "session_id string, selling_price double"))
    got = {(r["session_id"], r["selling_price"]): (r["sess_price_std"], r["sess_price_z"], r["sess_n_items"]) for r in df.collect()}
    assert got[("one", 5.0)] == (0.0, 0.0, 1) and got[("same", 3.0)] == (0.0, 0.0, 2)
    assert got[("gap", None)][1] == pytest.approx((0 - 3) / 2**0.5)


def test_fills(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, "a", 4.0), (3.0, "a", None)], "x double, s string, y double")
    assert [tuple(r) for r in clean.fill_by_type(df).collect()][0] == (1.0, "UNKNOWN", 0.0)
    assert [r["x"] for r in clean.fill_defaults(df, {}, ["x"]).collect()] == [1.0, 2.0, 3.0]
    assert [r["s"] for r in clean.impute(df, df, ["x"], ["s"]).collect()] == ["a", "a", "a"]
    flagged = clean.flag_missing(df, ["s"]).first()
    assert (flagged["s"], flagged["s_missing"]) == ("missing", 1)
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (2.0,)], "r double")
    assert [r["r"] for r in clean.zero_nonfinite(odd, ["r"]).collect()] == [0.0, 0.0, 2.0]


def test_mode_takes_the_smaller_on_ties(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("k", None), ("k", None)], "k string, v string")
    assert aggregates.mode_per_key(df, ["k"], "v", "m").first()["m"] == "a"
    assert clean.modes(df, ["v"]) == {"v": "a"}


def test_affinity_needs_its_columns(spark):
    df = spark.createDataFrame([("u", 1)], "user_id string, content_id int")
    with pytest.raises(KeyError):
        fitted.user_term_affinity(df, df)


def test_affinity_medians_weigh_pairs_by_rows(spark):
    schema = "user_id string, search_term string, content_id int, selling_price double"
    train = spark.createDataFrame([("u", "t", 1, 10.0), ("u", "t", 2, 10.0), ("v", "t", 1, 40.0)], schema)
    test = spark.createDataFrame([("w", "t", 1, 1.0)], schema)
    _, out = fitted.user_term_affinity(train, test)
    row = out.first()
    assert (row["user_term_freq"], row["user_term_avg_price"]) == (0, 10.0)


def test_codes_and_scaling(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, None)], "c string, x double")
    test = spark.createDataFrame([("z", 2.0), ("a", None)], "c string, x double")
    coded = {r["c"]: r["c_code"] for r in encode.encode_train(train, test, ["c"]).collect()}
    assert coded == {"z": 0, "a": 1}
    left, right = encode.encode_union(train, test, ["c"])
    assert {r["c"]: r["c_label"] for r in left.union(right).collect()} == {"a": 0, "b": 1, "unknown": 2, "z": 3}
    assert sorted(r["x"] for r in encode.scale_standard(train, test, ["x"]).collect()) == [0.0, 0.0]
    assert sorted(r["x"] for r in encode.scale_minmax(train, test.where("x is not null"), ["x"]).collect()) == [0.5]


def test_profile_roles(spark):
    df = spark.range(200).select(
        "id", (F.col("id") % 3).alias("few"), (F.col("id") % 2 == 0).alias("flag"), F.current_date().alias("day"), (F.col("id") * 1.5).alias("value")
    )
    roles = {r["column_name"]: (r["role"], r["note"]) for r in profile.profile(df, "t").collect()}
    assert roles == {
        "id": ("categorical", "id-like"), "few": ("categorical", "low-cardinality (3)"), "flag": ("categorical", "bool"),
        "day": ("numeric", "datetime"), "value": ("numeric", "continuous"),
    }
    assert profile.time_column(spark.createDataFrame([("x", 5)], "name string, epoch int")) == "epoch"


def test_relevance_prefers_the_rarer_token(spark):
    documents = spark.createDataFrame([(1, "red ring"), (2, "red gear"), (3, "blue ring ring")], "content_id int, product_text string")
    rows = spark.createDataFrame([(1, "blue ring"), (2, "blue ring"), (3, "blue ring"), (3, "")], "content_id int, search_term string")
    got = {(r["content_id"], r["search_term"]): r["relevance"] for r in relevance.bm25(rows, documents).collect()}
    assert got[(3, "blue ring")] > got[(1, "blue ring")] > got[(2, "blue ring")] == 0.0 == got[(3, "")]


def test_batch_scorer_takes_any_function(spark):
    pairs = spark.createDataFrame([("a b", "b c"), ("", "x")], "query string, text string")
    assert [r["score"] for r in relevance.score_pairs(pairs).collect()] == [0.5, 0.0]
    long = relevance.score_pairs(pairs, lambda batch: batch["text"].str.len().astype("float64"), "n")
    assert [r["n"] for r in long.collect()] == [3.0, 1.0]


def test_profile_counts_by_every_way(spark):
    """Exact, sketched and settled counts agree on small tables; columns of nulls, of lists and empty tables have counts too."""
    from pyspark.sql import functions as F

    df = spark.range(500).select(
        F.col("id").alias("many"), (F.col("id") % 7).alias("few"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, F.array(F.col("id") % 3)).alias("list"), F.when(F.col("id") % 5 == 0, F.lit(0.0)).otherwise(-0.0).alias("zero"),
    )
    want = {"many": (500, 500), "few": (500, 7), "none": (0, 0), "list": (250, 3), "zero": (500, 1)}
    for way in ("exact", "settled"):
        got = {r.column_name: (r.non_null_rows, r.distinct_values) for r in profile.profile(df, "t", way).collect()}
        assert {c: v for c, v in got.items() if way == "exact" or c != "many"} == {c: v for c, v in want.items() if way == "exact" or c != "many"}
        assert abs(got["many"][1] - 500) <= 50
    assert {(r.non_null_rows, r.distinct_values) for r in profile.profile(df.limit(0), "t").collect()} == {(0, 0)}
    plan = profile.profile(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_catalog_reads_footers_only(spark, sf):
    from sessionrank.sources import tables

    found = tables.row_counts(spark, {"lineitem": f"{sf}/lineitem.parquet", "absent": f"{sf}/absent.parquet"})
    assert "PushedAggregation: [COUNT(*)]" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("lineitem", spark.read.parquet(f"{sf}/lineitem.parquet").count(), 11)]
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_token_share_of_odd_texts(spark):
    rows = [("Red ring red", "a RED thing"), ("", "x"), (None, "x"), ("x", None), ("  a\tb ", "b  a c"), ("é", "É")]
    got = relevance.score_pairs(spark.createDataFrame(rows, "query string, text string")).collect()
    assert [r.score for r in got] == [0.5, 0.0, 0.0, 0.0, 1.0, 1.0]
    assert relevance.score_pairs(spark.createDataFrame([], "query string, text string")).count() == 0
