"""The packed factorisation machine gives Spark ML's coefficients, from one packing of the rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier
from pyspark.sql import functions as F

from sessionrank.models import factors, heads


def test_coefficients_are_those_of_the_library(spark, monkeypatch):
    df = spark.range(700).select((F.rand(1) * 2 - 1).alias("a"), (F.rand(2) - 0.5).alias("b"), F.lit(0.0).alias("c")).withColumn("y", (F.col("a") * F.col("b") + F.col("a") > 0).cast("int")).persist()
    cols, calls, plain = ["a", "b", "c"], [], factors.gradient
    monkeypatch.setattr(factors, "gradient", lambda *a: calls.append(a) or plain(*a))
    made = heads.fit_factorization(df, cols, "y", factors=3, rounds=12)
    want = Pipeline(stages=[heads.assembler(cols), FMClassifier(labelCol="y", factorSize=3, maxIter=12, stepSize=0.05, seed=heads.SEED)]).fit(df).stages[-1]
    got = made.stages[-1]
    assert len(calls) == 12 and got.intercept == pytest.approx(want.intercept, abs=1e-9)
    assert np.allclose(got.linear.toArray(), want.linear.toArray(), atol=1e-9) and np.allclose(got.factors.toArray(), want.factors.toArray(), atol=1e-9)
    p = heads.positive_probability(made, df, "p").agg(F.min("p"), F.max("p")).first()
    assert 0 <= p[0] < 0.3 and 0.7 < p[1] <= 1


def test_no_rows(spark):
    with pytest.raises(ValueError):
        heads.fit_factorization(spark.createDataFrame([], "a double, y int"), ["a"], "y")
