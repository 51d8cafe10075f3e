"""Packed tree growing: sampled rows, thresholds, sessions spread over blocks, and how little a round writes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionrank.models import boosting, heads, trees
from sessionrank.session import durable

COLS = ["x", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("session_id"), F.col("id").alias("content_id"), F.round(F.rand(1) * 8).alias("x"), F.round(F.rand(2) * 8).alias("noise"))
    df = df.withColumn("session_id", F.when(F.col("session_id") != 5, F.col("session_id"))).withColumn("x", F.when(F.col("content_id") % 50 > 0, F.col("x")))
    df = df.withColumn("_rel", F.coalesce("x", F.lit(9.0)) / 9 + F.rand(3) * 0.2).withColumn("ordered", (F.col("_rel") > 0.8).cast("int"))
    return durable(heads.assembler(COLS).transform(df).withColumn("held_out", F.col("content_id") % 5 == 0))


def test_sampled_rows_are_those_of_the_key_hash(rows):
    for number, share in ((43, 0.8), (2000, 0.1)):
        inside = F.pmod(F.xxhash64("session_id", "content_id", F.lit(number)), F.lit(trees.SHARES)) < int(share * trees.SHARES)
        got = rows.select(F.xxhash64("session_id", "content_id").alias("k"), inside.alias("s")).collect()
        assert trees.in_sample(np.array([r.k for r in got]).view(np.uint64), number, share).tolist() == [r.s for r in got]


def test_thresholds():
    assert trees.cuts_of(np.array([3.0, 1.0, 1.0]), np.ones(3), 64).tolist() == [2.0]
    assert trees.cuts_of(np.array([1.0, np.nan, 2.0, np.nan]), np.ones(4), 64).tolist() == [1.5, 2.0]
    assert trees.cuts_of(np.full(3, 4.0), np.ones(3), 64).tolist() == []
    assert trees.cuts_of(np.arange(100.0), np.ones(100), 4).tolist() == [24.5, 49.5, 74.5]


@pytest.mark.parametrize("hot_rows", [1_000_000, 30])
def test_sessions_spread_over_blocks(rows, hot_rows, monkeypatch):
    """A session too large for a block, a session without an id and missing values give the tree of plain centring."""
    monkeypatch.setattr(trees, "BLOCK", 64)
    cuts = trees.find_cuts(rows, F.lit(True), None, 32, "session_id", "content_id")
    begun = rows.withColumn("_f", F.col("noise") / 9)
    loss = boosting.SessionSquares("_rel")
    blocks = trees.pack_rows(begun, cuts, "_rel", None, "held_out", "ordered", "session_id", "content_id", True, hot_rows)
    assert (blocks.where("hot >= 0").count() > 0) == (hot_rows == 30)
    tree = trees.grow(blocks, loss, cuts, 1, 1, 1, 1.0)
    data = begun.collect()
    session = np.array([-1 if r.session_id is None else r.session_id for r in data])
    e = np.array([r._rel - r._f for r in data])
    t = np.array([v - e[session == s].mean() for v, s in zip(e, session)])
    use = np.array([not r.held_out for r in data])
    x = np.array([[np.nan if r.x is None else r.x, r.noise] for r in data])
    best = max((np.mean(t[use & s]) ** 2 * np.sum(use & s) + np.mean(t[use & ~s]) ** 2 * np.sum(use & ~s), -j, -c) for j in range(2) for c in cuts[j] for s in [x[:, j] <= c])
    assert (tree.feature[0], tree.threshold[0]) == (-best[1], -best[2]) and tree.stats[0, 3] == use.sum()
    side = x[:, -best[1]] <= -best[2]
    assert list(tree.value[1:]) == pytest.approx([t[use & side].mean(), t[use & ~side].mean()])
    scored = tree.model(2).transform(rows).select("content_id", "prediction").collect()
    assert [r.prediction for r in scored] == pytest.approx([tree.value[1] if s else tree.value[2] for s in side])


def test_rounds_write_no_tables(rows, monkeypatch):
    """The table is packed once; before, every round of a loss of sessions wrote all of it."""
    calls = []
    for module in (boosting, trees):
        monkeypatch.setattr(module, "durable", lambda df: calls.append(df) or durable(df))
    settings = boosting.Settings(rounds=6, patience=6, every=3, depth=2, step=0.3, subsample=1.0)
    made = boosting.boost(rows, boosting.SessionSquares("_rel"), settings, "held_out", "ordered")
    assert made.rounds == 6 and [r for r, _ in made.history] == [1, 2, 3, 4, 5, 6] and len(calls) <= 3


def test_folded_scores(rows, monkeypatch):
    """Scores checkpointed on the way give the same trees; held-out sessions of one kind count as chance."""
    settings = boosting.Settings(rounds=5, patience=9, every=2, depth=2, step=0.3, subsample=0.7)
    one = rows.withColumn("weight", F.lit(1.0))
    a = boosting.boost(one, boosting.Logistic("ordered"), settings, "held_out")
    monkeypatch.setattr(boosting, "FOLD", 2)
    b = boosting.boost(one, boosting.Logistic("ordered"), settings, "held_out")
    assert dict(a.history) == pytest.approx(dict(b.history)) and len(a.history) == 5
    plain = boosting.boost(one.withColumn("ordered", F.when(F.col("held_out"), 1).otherwise(F.col("ordered"))), boosting.Logistic("ordered"), settings, "held_out")
    assert plain.history == [(r, boosting.CHANCE) for r in range(1, 6)] and len(plain.trees) == 1


def test_no_rows(rows):
    with pytest.raises(ValueError):
        boosting.boost(rows.where("false"), boosting.SessionSquares("_rel"), boosting.Settings(rounds=1))
