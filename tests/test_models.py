"""Spark ML heads find a planted signal."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sessionrank.models import heads
from sessionrank.operators import ranking
from sessionrank.session import durable, output_path


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(3000).select(
        (F.col("id") % 150).alias("session_id"), F.col("id").alias("content_id"), F.rand(1).alias("x"), F.rand(2).alias("noise")
    )
    df = df.withColumn("ordered", (F.col("x") + F.rand(3) * 0.4 > 1.0).cast("int"))
    return durable(df.withColumn("clicked", F.greatest("ordered", (F.rand(4) < 0.1).cast("int"))))


FEW = heads.Trees(rounds={"ordered": 3, "clicked": 3, "any": 3}, depth=3, step=0.3, subsample=1.0)
COLS = ["x", "noise"]


def auc(df, score):
    return ranking.group_auc(df, score).first()["ordered_auc"]


def test_heads_beat_chance_and_repeat(planted, spark):
    flagged = planted.withColumn("held_out", F.col("session_id") > 120)
    models = heads.fit_heads(flagged, COLS, FEW, validation="held_out")
    scored = heads.score_heads(models, planted)
    assert auc(scored, F.col("p_order") * 0.45 + F.col("p_click") * 0.55) > 0.8
    assert scored.where("p_order < 0 or p_order > 1 or p_click < 0 or p_click > 1").count() == 0
    weights = {r["feature"]: r["importance"] for r in heads.importances(models["ordered"], COLS).collect()}
    assert weights["x"] > weights["noise"]
    path = output_path(spark, "model")
    models["ordered"].write().save(path)
    again = heads.positive_probability(PipelineModel.load(path), planted, "q")
    assert again.join(scored.select("content_id", "p_order"), "content_id").where("q <> p_order").count() == 0


def test_rankers_beat_chance(planted):
    assert auc(heads.raw_score(heads.fit_preferences(planted, COLS), planted), "score") > 0.8
    assert auc(heads.raw_score(heads.fit_centred_ranker(planted, COLS, rounds=3, depth=3), planted), "score") > 0.8


def test_preferences_grow_with_rows_not_pairs(planted):
    prefs = heads.preference_rows(planted, COLS, "ordered")
    assert prefs.count() <= 2 * planted.where("ordered = 1").count()


def test_linear_models(planted):
    banded = planted.withColumn("band", F.floor(F.col("x") * 10).cast("string"))
    wide = heads.fit_wide(banded, ["band"], "ordered", size=1 << 8, rounds=10)
    assert auc(heads.positive_probability(wide, banded, "p"), "p") > 0.8
    factor = heads.fit_factorization(planted, COLS, "ordered", rounds=30)
    assert auc(heads.positive_probability(factor, planted, "p"), "p") > 0.6
