"""Metrics: the published example, edge cases, pair counting."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sessionrank.operators import blend, ranking, submission
from sessionrank.operators.ranking import RankingError

TRUTH = "session_id string, ordered_items string, clicked_items string, all_items string"
PRED = "session_id string, prediction string"


def test_two_session_example_scores_one(spark):
    truth = spark.createDataFrame([("s1", "c1", "c1 c2", "c1 c2 c3 c4 c5 c6"), ("s2", "c3", "c3 c4", "c3 c4 c5 c6 c7 c8")], TRUTH)
    pred = spark.createDataFrame([("s1", "c1 c2 c5 c3 c4 c6"), ("s2", "c3 c4 c5 c6 c7 c8")], PRED)
    assert ranking.score(truth, pred) == pytest.approx(1.0)


def test_edges_of_the_list_metric(spark):
    truth = spark.createDataFrame(
        [("none", "", "", "a b"), ("all", "a b", "a b", "a b"), ("one", "a", "a", "a"), ("dup", "b", "b", "a b c"), ("absent", "a", "a", "a b")], TRUTH
    )
    pred = spark.createDataFrame([("none", "a b"), ("all", "b a"), ("one", "a"), ("dup", " a  b a c b ")], PRED)
    row = ranking.score_lists(truth, pred).first()
    # only "dup" can be scored: b is second of three
    assert (row["n_ordered"], row["ordered_auc"], row["score"]) == (1, 0.5, pytest.approx(0.5))


def test_set_mismatch_is_an_error(spark):
    truth = spark.createDataFrame([("s", "a", "a", "a b")], TRUTH)
    pred = spark.createDataFrame([("s", "a c")], PRED)
    with pytest.raises(RankingError, match="1 items missing"):
        ranking.score(truth, pred)
    with pytest.raises(RankingError):
        ranking.score(truth.drop("all_items"), pred)


def test_no_scorable_session_gives_chance(spark):
    truth = spark.createDataFrame([("s", "", "", "a b")], TRUTH)
    assert ranking.score(truth, spark.createDataFrame([("s", "a b")], PRED)) == pytest.approx(0.5)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    rows = [(f"s{i % 20}", i, rng.randrange(4) / 3, rng.randrange(4) / 3, int(rng.random() < 0.3), int(rng.random() < 0.5)) for i in range(200)]
    return rows, spark.createDataFrame(rows, "session_id string, content_id bigint, p_order double, p_click double, ordered int, clicked int")


def test_closed_form_equals_pair_counting(scored):
    rows, df = scored
    got = {r["session_id"]: r["ordered_auc"] for r in ranking.session_auc(df, "p_order").collect()}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))
        pairs = [(p, q) for p, q in itertools.product(range(len(mine)), repeat=2) if mine[p][4] == 1 and mine[q][4] == 0]
        want = sum(p < q for p, q in pairs) / len(pairs) if pairs else None
        assert got[s] == (pytest.approx(want) if pairs else None)


def test_row_and_list_metrics_agree(scored):
    _, df = scored
    mix = blend.two_heads()
    by_rows = ranking.group_auc(df, mix).first()["score"]
    by_lists = ranking.score(submission.solution_lists(df), submission.prediction_lists(df, mix))
    assert by_rows == pytest.approx(by_lists)
    precision = ranking.graded_precision(df, mix).agg(F.avg("average_precision")).first()[0]
    lists = ranking.graded_precision_lists(submission.solution_lists(df), submission.prediction_lists(df, mix)).first()["group_map"]
    assert precision == pytest.approx(lists)


def test_weight_grid_equals_single_scores(scored):
    _, df = scored
    grid = {r["w"]: r["score"] for r in blend.score_weights(df, [0.1, 0.45, 0.9]).collect()}
    hot = {r["w"]: r["score"] for r in blend.score_weights(df, [0.1, 0.45, 0.9], hot_rows=15).collect()}
    for w, value in grid.items():
        assert value == pytest.approx(ranking.group_auc(df, blend.two_heads(w)).first()["score"])
        assert hot[w] == pytest.approx(value)


def test_simplex_weights_sum_to_one():
    cells = blend.simplex(0.1)
    assert len(cells) == 66 and all(abs(sum(c) - 1) < 1e-9 and min(c) >= 0 for c in cells)
    assert len(blend.grid(0.5, 0.9, 41)) == 41


def test_global_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "p double, y int")
    for hot in (1_000_000, 2):
        assert ranking.global_auc(df, "p", "y", hot_rows=hot).first()["auc"] == pytest.approx(3.5 / 4)
    assert ranking.global_auc(df.where("y = 1"), "p", "y").first()["auc"] == 0.5


def test_submission_check_finds_faults(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("b",)], "session_id string")
    pred = spark.createDataFrame([("b", "1"), ("b", "2"), ("z", "3")], PRED)
    row = submission.check(pred, expected).first().asDict()
    assert row == {"n_rows": 3, "n_expected": 2, "n_missing": 1, "n_unexpected": 1, "n_repeated": 1, "columns_ok": True}


def test_blend_grids_over_packed_and_large_sessions(scored):
    """Three-head and power blends: every candidate equals its single score, packed or range-partitioned; missing scores rank last."""
    _, df = scored
    df = df.withColumn("p_any", F.greatest("p_order", "p_click"))
    cells = [(0.5, 0.3, 0.2), (0.3, 0.1, 0.6)]
    for hot_rows in (50_000, 15):
        for r in blend.score_simplex(df, cells, hot_rows).collect():
            assert r.score == pytest.approx(ranking.group_auc(df, blend.three_heads(r.w_order, r.w_any, r.w_click)).first()["score"])
        for r in blend.score_powers(df, [(0.6, 1.5, 0.5)], hot_rows).collect():
            assert r.score == pytest.approx(ranking.group_auc(df, blend.power(0.6, 1.5, 0.5)).first()["score"])
    gaps = df.withColumn("p_order", F.when(F.col("content_id") % 5 > 0, F.col("p_order")))
    a, b = (blend.score_weights(gaps, [0.5], n).first()["score"] for n in (50_000, 15))
    assert a == pytest.approx(b)
    none = blend.score_weights(df.where("ordered > 5"), [0.2, 0.4]).collect()
    assert [(r.w, r.score, r.n_ordered) for r in none] == [(0.2, 0.5, 0), (0.4, 0.5, 0)]


def test_list_rows_reads_each_side_once(spark):
    base = spark.range(4).withColumnRenamed("id", "session_id")
    truth = base.selectExpr("session_id", "if(session_id = 1, null, '1 2') as ordered_items", "'2' as clicked_items", "'1 2 3' as all_items")
    pred = spark.range(1, 6).selectExpr("nullif(id, 5) as session_id", "if(id = 2, null, '3 3 1 9') as prediction")
    twice = truth.unionByName(truth.where("session_id = 3"))
    rows = ranking.list_rows(truth, pred)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    plain = [("1", 2, "x"), ("2", None, "oc"), ("3", 1, "x"), ("9", 3, "-")]
    for found in (rows, ranking.list_rows(twice, pred.unionByName(pred)), ranking.list_rows(truth, pred, written=True)):
        got = {(r["session_id"], r["item"]): (r["rank"], r["ordered"], r["clicked"], r["in_truth"]) for r in found.collect()}
        assert len(got) == found.count() == 4 + 3 + 4
        assert [got[3, i][0] for i, _, _ in plain] == [p for _, p, _ in plain]
        assert got[3, "2"] == (None, 1, 1, 1) and got[3, "9"] == (3, 0, 0, 0) and got[3, "1"] == (2, 1, 0, 1)
        assert got[1, "2"] == (None, 0, 1, 1) and got[1, "1"] == (2, 0, 0, 1) and got[2, "3"] == (None, 0, 0, 1)
