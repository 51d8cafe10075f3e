"""Joins that look up codes."""

from pyspark.sql import functions as F

from sessionrank.operators import encode


def test_few_codes_are_broadcast_and_the_wide_side_is_not_exchanged(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 6).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("c"))
    train = rows.where("id % 5 != 4")
    expected = {i: 0 if i % 5 in (0, 4) else i % 5 for i in range(3000)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is asked for is broadcast
    try:
        few = encode.encode_train(train, rows, ["c"])
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        assert {r["id"]: r["c_code"] for r in few.collect()} == expected
        monkeypatch.setattr(encode, "SMALL_CODES", 2)
        many = encode.encode_train(train, rows, ["c"])
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        assert {r["id"]: r["c_code"] for r in many.collect()} == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
