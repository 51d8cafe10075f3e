"""The boosting loop and the pairwise ranker against plain numpy, early stops, and what is kept."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sessionrank.models import boosting, heads, pairwise, tuning
from sessionrank.operators import ranking
from sessionrank.session import durable, output_path

COLS = ["x", "noise"]


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(1200).select((F.col("id") % 60).alias("session_id"), F.col("id").alias("content_id"), F.round(F.rand(1) * 8).alias("x"), F.round(F.rand(2) * 8).alias("noise"))
    df = df.withColumn("ordered", (F.col("x") / 8 + F.rand(3) * 0.4 > 1.0).cast("int"))
    return durable(df.withColumn("clicked", F.greatest("ordered", (F.rand(4) < 0.1).cast("int"))).withColumn("held_out", F.col("session_id") >= 45))


def plain_trees(x, target, weight, depth):
    """A regression tree by exhaustive search over all thresholds; returns its prediction of every row."""

    def grow(rows, depth):
        out = np.full(len(rows), np.average(target[rows], weights=weight[rows]))
        best = None
        if depth == 0:
            return out

        def cost(part):
            return np.sum(weight[part] * (target[part] - np.average(target[part], weights=weight[part])) ** 2)

        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                c = cost(left) + cost(right)
                if best is None or c < best[0] - 1e-9:
                    best = (c, left, right)
        if best is None or cost(rows) - best[0] <= 1e-9:
            return out
        place = {r: i for i, r in enumerate(rows)}
        for part in best[1:]:
            out[[place[r] for r in part]] = grow(part, depth - 1)
        return out

    return grow(np.arange(len(target)), depth)


def test_session_loss_falls_and_equals_numpy(planted):
    """Every round centres errors per session anew; scores equal a plain version round by round."""
    settings = boosting.Settings(rounds=4, depth=2, step=0.5, subsample=1.0, every=2, bins=32)
    rows = heads.assembler(COLS).transform(planted.withColumn("_rel", (F.col("ordered") * 0.7 + F.col("clicked") * 0.3)))
    made = boosting.boost(rows, boosting.SessionSquares("_rel"), settings, watch_loss=True)
    assert made.rounds == 4 and all(b < a for a, b in zip(made.losses, made.losses[1:]))
    got = {r.content_id: r.prediction for r in made.model().transform(rows).collect()}
    data = sorted(rows.select("content_id", "session_id", "x", "noise", "_rel").collect())
    x, session, rel = np.array([[r.x, r.noise] for r in data]), np.array([r.session_id for r in data]), np.array([r._rel for r in data])
    f, losses = np.zeros(len(data)), []

    def centred(e):
        return e - (np.bincount(session, e) / np.bincount(session))[session]

    for _ in range(4):
        f = f + 0.5 * plain_trees(x, centred(rel - f), np.ones(len(f)), 2)
        losses.append(np.sqrt(np.mean(centred(rel - f) ** 2)))
    assert losses == pytest.approx(made.losses, abs=1e-9)
    assert [got[r.content_id] for r in data] == pytest.approx(list(f), abs=1e-9)


def test_logistic_rounds_equal_numpy(planted):
    settings = boosting.Settings(rounds=3, depth=2, step=0.3, subsample=1.0, every=2, bins=32)
    rows = heads.assembler(COLS).transform(heads.class_weight(planted, "clicked"))
    made = boosting.boost(rows, boosting.Logistic("clicked"), settings, watch_loss=True)
    data = sorted(rows.select("content_id", "x", "noise", "clicked", "weight").collect())
    x, y, w = np.array([[r.x, r.noise] for r in data]), np.array([r.clicked for r in data]), np.array([r.weight for r in data])
    f, losses = np.zeros(len(y)), []
    for _ in range(3):
        p = 1 / (1 + np.exp(-f))
        f = f + 0.3 * plain_trees(x, (y - p) / (p * (1 - p)), w * p * (1 - p), 2)
        losses.append(np.average(np.log1p(np.exp(-np.abs(f))) + np.maximum(f, 0) - f * y, weights=w))
    assert losses == pytest.approx(made.losses, abs=1e-9) and losses[2] < losses[1] < losses[0]


def test_stop_by_held_out_sessions(planted, spark):
    """Held-out labels that contradict the others end the loop after its patience, and the best round is kept."""
    turned = planted.withColumn("ordered", F.when(F.col("held_out"), 1 - F.col("ordered")).otherwise(F.col("ordered")))
    trees = heads.Trees(rounds={"ordered": 40}, depth=3, step=0.3, subsample=1.0, patience=3, every=2)
    made = heads.boosted_head(turned, "ordered", COLS, trees, "held_out")
    assert made.rounds < 40 and [r for r, _ in made.history] == list(range(1, made.rounds + 1))
    best = max(made.history, key=lambda h: (h[1], -h[0]))
    assert len(made.trees) == best[0] and made.rounds - best[0] >= 3
    scored = made.model().transform(heads.assembler(COLS).transform(turned.where("held_out")))
    each = ranking.session_auc(scored, "prediction", labels=("ordered",)).agg(F.avg("ordered_auc")).first()[0]
    assert each == pytest.approx(best[1])


def test_fixed_rounds_and_saved_models(planted, spark):
    models = heads.full_refit(planted, COLS, {"ordered": 2, "clicked": 3}, heads.Trees(depth=2, step=0.3))
    assert {k: m.stages[-1].getNumTrees for k, m in models.items()} == {"ordered": 2, "clicked": 3}
    assert boosting.REFIT_ROUNDS["ordered"] == 486 and boosting.REFIT_ROUNDS["clicked"] == 1421
    path = output_path(spark, "model")
    models["clicked"].write().save(path)
    again = heads.positive_probability(PipelineModel.load(path), planted, "q").join(heads.positive_probability(models["clicked"], planted, "p").select("content_id", "p"), "content_id")
    assert again.where("p = q").count() == 1200 and again.where("p < 0 or p > 1").count() == 0


def all_pairs(x, pos, session, w):
    s, loss, slope, n = x @ w, 0.0, np.zeros(len(w)), 0
    for i in np.flatnonzero(pos):
        for j in np.flatnonzero(~pos & (session == session[i])):
            gap = max(0.0, 1 - (s[i] - s[j]))
            loss, slope, n = loss + gap * gap, slope - 2 * gap * (x[i] - x[j]), n + 1
    return loss, slope, n


@pytest.mark.parametrize("hot_rows", [1_000_000, 15])
def test_pair_loss_equals_all_pairs(spark, hot_rows):
    """Packed sessions and range-partitioned ones give what writing every pair gives; ties and one-sided sessions too."""
    pick = np.random.default_rng(3)
    session = pick.choice([0, 0, 0, 1, 2, 3, 4, 5], 120)
    x, pos = np.round(pick.normal(size=(120, 2)), 1), pick.random(120) < 0.3
    pos[session == 5] = True
    rows = [(int(s), i, int(p), float(a), float(b)) for i, (s, p, (a, b)) in enumerate(zip(session, pos, x))]
    df = spark.createDataFrame(rows, "session_id bigint, content_id bigint, ordered int, x double, noise double")
    pairs = pairwise.Pairs(df, COLS, "ordered", "session_id", "content_id", hot_rows)
    assert (pairs.hot is None) == (hot_rows > 120)
    for w in (np.zeros(2), np.array([0.7, -0.2]), np.array([-3.0, 1.5])):
        loss, slope, n = pairs(w)
        want = all_pairs(x, pos, session, w)
        assert loss == pytest.approx(want[0]) and slope == pytest.approx(want[1]) and n == want[2]


def test_pairwise_optimum(planted):
    weights, losses = pairwise.fit_pairs(planted, COLS, "ordered")
    assert all(b < a for a, b in zip(losses, losses[1:])) and abs(weights[0]) > 10 * abs(weights[1])
    pairs = pairwise.Pairs(planted, COLS, "ordered", "session_id", "content_id")
    loss, slope, n = pairs(weights)
    assert np.abs(slope / n + 1e-3 * weights).max() < 1e-3
    scored = heads.raw_score(heads.fit_preferences(planted, COLS), planted)
    assert ranking.group_auc(scored, "score").first()["ordered_auc"] > 0.9


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5, 0.1)], "session_id bigint, content_id bigint, ordered int, x double, noise double")
    assert pairwise.fit_pairs(df, COLS, "ordered")[0].tolist() == [0.0, 0.0]


def test_resumed_rounds_equal_one_run(planted):
    rows = heads.assembler(COLS).transform(heads.class_weight(planted, "clicked"))
    settings = boosting.Settings(rounds=4, depth=2, step=0.3, subsample=0.7, every=3)
    whole = boosting.boost(rows, boosting.Logistic("clicked"), settings)
    half = boosting.boost(rows, boosting.Logistic("clicked"), boosting.Settings(rounds=2, depth=2, step=0.3, subsample=0.7, every=3))
    both = boosting.boost(rows, boosting.Logistic("clicked"), settings, after=half)
    a, b = (m.model().transform(rows).select("content_id", F.col("prediction").alias(n)) for m, n in ((whole, "p"), (both, "q")))
    assert a.join(b, "content_id").where("abs(p - q) < 1e-9").count() == 1200 and len(both.trees) == 4
    assert len(heads.importances(PipelineModel([heads.assembler(COLS), whole.model()]), COLS).collect()) == 2


def test_halving_keeps_the_better_settings(planted, spark):
    """A step that cannot learn leaves at the first rung; the winner has the most rounds and its score is the group AUC."""
    grid = [boosting.Settings(rounds=4, depth=2, step=s, subsample=1.0, every=2) for s in (-0.3, 0.3, -0.1, 0.1)]
    train, val = planted.where("not held_out"), planted.where("held_out")
    trials = tuning.halving(train, val, COLS, grid, least=1)
    assert [t.rung for t in trials] == [2, 1, 0, 0] and {t.number for t in trials[:2]} == {1, 3}
    assert [len(t.heads["ordered"].trees) for t in trials] == [4, 2, 1, 1]
    assert trials[0].score > 0.7 > 0.5 > max(t.score for t in trials[2:])
    again = tuning.table(spark, tuning.halving(train, val, COLS, grid, least=1)).collect()
    assert again == tuning.table(spark, trials).collect() and again[0].place == 1
