"""Sums over text vectors read the stored values only, not arrays of the whole width."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionrank.models import heads
from sessionrank.plans.registry import QUERIES


def test_stored_values_give_the_sums_of_whole_vectors(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None), (4, "b"), (5, "a b d e")], "doc_id bigint, text string")
    vectors = heads.text_vectors(df, "text", size=64)
    whole, held = vector_to_array("vector"), heads.stored_values("vector")

    def sums(v):
        return F.struct(F.size(F.filter(v, lambda x: x > 0)), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))

    got = vectors.select(sums(whole).alias("a"), sums(held).alias("b"), F.size(held).alias("n")).collect()
    assert len(got) == 5 and all(r.a == r.b for r in got) and max(r.n for r in got) <= 4


def test_query_writes_out_no_whole_vectors(spark, sf):
    plan = QUERIES["vectorize_text"](spark, sf)._jdf.queryExecution().toString()
    assert "vector_to_array" not in plan.lower() and "values" in plan
