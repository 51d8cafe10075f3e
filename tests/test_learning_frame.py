"""The training table of the learning queries, the looks at held-out rows, and what the search of settings makes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionrank.models import boosting, heads, trees, tuning
from sessionrank.operators import history, packed
from sessionrank.plans import learning
from sessionrank.session import durable
from sessionrank.sources import fixtures as fx

COLS = ["x", "noise"]


def listed(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_frame_moves_rows_twice(spark, sf, monkeypatch):
    """Lines go once by session and once by item, and are written as columns; before, rows were exchanged seven times and checkpointed twice."""
    plans = []
    monkeypatch.setattr(learning, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df))
    monkeypatch.setattr(history, "crowding", lambda frames, keys: (0, 0))
    train, val = learning._frame(spark, sf)
    assert plans[0].count("Exchange hashpartitioning") <= 6 and plans[0].count("l_partkey") > 0
    assert sum("l_orderkey" in line for line in plans[0].splitlines() if "FileScan" in line) == 1
    assert train.count() > 5 * val.count() > 0


def test_frame_of_crowded_keys_is_the_same(spark, sf, monkeypatch):
    wanted = [listed(df) for df in learning._frame(spark, sf)]
    monkeypatch.setattr(history, "MOST", 0)
    monkeypatch.setattr(fx, "MOST", 0)
    assert [listed(df) for df in learning._frame(spark, sf)] == wanted


def held_rows(spark):
    df = spark.range(400).select(F.when(F.col("id") % 7 > 0, F.col("id") % 30).alias("session_id"), F.col("id").alias("content_id"), F.round(F.rand(5) * 4).alias("x"), F.round(F.rand(6) * 4).alias("noise"))
    return heads.assembler(COLS).transform(durable(df.withColumn("ordered", (F.rand(7) < 0.3).cast("int")).withColumn("weight", F.lit(1.0)).withColumn("held_out", F.col("content_id") % 3 == 0)))


def test_looks_move_no_rows(spark, monkeypatch):
    """Held-out sessions lie whole in blocks: before, every look exchanged a row a round for each of their rows."""
    monkeypatch.setattr(boosting, "rank_within", lambda *a: pytest.fail("rows are ranked by an exchange"))
    settings = boosting.Settings(rounds=4, patience=9, every=2, depth=2, step=0.3, subsample=1.0)
    made = boosting.boost(held_rows(spark), boosting.Logistic("ordered"), settings, "held_out")
    assert [r for r, _ in made.history] == [1, 2, 3, 4]


def test_looks_at_spread_sessions(spark):
    """Sessions larger than a block, one without an id among them, count as whole ones do."""
    rows = held_rows(spark).where("held_out").withColumn("_f", F.lit(0.0))
    cuts = trees.find_cuts(rows, F.lit(True), None, 16, "session_id", "content_id")
    tree = trees.Tree(np.array([0, 0, 0], np.int32), np.array([1, 255, 255], np.uint8), np.zeros(3), np.array([1, 1, 2], np.int32), np.zeros(3), np.array([[2.0, 0, 0, 2], [1, -1, 1, 1], [1, 1, 1, 1]]), 1)
    found = []
    for hot_rows in (1_000, 8):
        blocks = trees.pack_watched(rows, cuts, "ordered", "session_id", "content_id", hot_rows)
        assert boosting.is_spread(blocks) == (hot_rows == 8)
        found.append(boosting.round_scores(trees.advanced(blocks, [tree, tree], 0.5), hot_rows == 8, "ordered", "session_id", "content_id"))
    assert sorted(found[0]) == [0, 1] and found[0] == pytest.approx(found[1]) and found[0][0] == found[0][1]


def test_coded_values():
    for values in (np.array([1.0, 2.5, 1.0, np.nan]), np.arange(300.0), np.zeros(0)):
        import pyarrow as pa

        assert np.array_equal(packed.uncoded(pa.py_buffer(packed.coded(values))), values, equal_nan=True)
    assert len(packed.coded(np.arange(10_000) % 2 * 1.0)) < 10_100


def test_search_is_not_cut_short(spark, sf, monkeypatch):
    """the trials of the query made 1, 2 and 4 rounds; now 10, 20 and 40, the search's own numbers."""
    asked = {}
    monkeypatch.setattr(learning, "frame", lambda spark, sf: ("train", "val"))
    monkeypatch.setattr(tuning, "halving", lambda *a, **more: asked.update(grid=a[3], **more) or [])
    monkeypatch.setattr(tuning, "table", lambda spark, trials: trials)
    learning.tune_parameters(spark, sf)
    least, keep = asked.get("least", 10), asked.get("keep", 2)
    assert least >= 10 and min(s.rounds for s in asked["grid"]) >= least * keep ** int(np.log2(len(asked["grid"])))


def test_search_packs_once_a_label(spark, monkeypatch):
    """Four trials over three rungs read two packings; before, every trial and rung wrote its own."""
    calls = []
    monkeypatch.setattr(trees, "pack_rows", lambda *a: calls.append(a[2]) or pack_rows(*a))
    rows = held_rows(spark).drop("features", "weight").withColumn("clicked", F.greatest("ordered", (F.rand(9) < 0.1).cast("int")))
    grid = [boosting.Settings(rounds=2, depth=1, step=s, subsample=1.0) for s in (0.1, 0.3)]
    trials = tuning.halving(rows.where("not held_out"), rows.where("held_out"), COLS, grid, least=1)
    assert calls == ["ordered", "clicked"] and [len(t.heads["ordered"].trees) for t in trials] == [2, 1]


pack_rows = trees.pack_rows
