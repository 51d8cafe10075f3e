"""Boosted heads, rankers and linear models on the driver tables.

Labels there are random, so the held-out score ends boosting early; most rounds are a parameter,
here small because every round is some jobs. The ``check_`` queries give of each model what SQL
can say of it: the rows it scored, none without a score, none out of range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.models import boosting, heads, tuning
from sessionrank.operators import encode, history, ranking, splits
from sessionrank.operators.history import Running
from sessionrank.plans.registry import query, views
from sessionrank.session import output_path, stored
from sessionrank.sources import fixtures as fx
from sessionrank.sources.tables import table

NUMERIC = ["attribute_type_count", "filterable_label_count", "merchant_count", "csw_click", "csw_orders", "tenure_days", "birth_year", "p_order", "p_click"]
CODED = ["leaf_category_code", "gender_code"]
FEATURES = NUMERIC + CODED
SOME = heads.Trees(rounds={"ordered": 20, "clicked": 20, "any": 20}, depth=4, step=0.1, patience=5, every=5)
REFIT = {"ordered": 6, "clicked": 18}  # the full fit has 486 and 1421 rounds, about as 1 to 3
ROW = ["session_id", "content_id"]


_FRAMES: dict[tuple[str, str], tuple] = {}


def frame(spark, sf):
    """(training rows, validation rows) with numeric features, written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FRAMES:
        _FRAMES[key] = _frame(spark, sf)
    return _FRAMES[key]


def _frame(spark, sf):
    # users meet the sessions, which are fewer than their items
    shoppers = fx.session_hours(spark, sf).join(fx.user_metadata(spark, sf), "user_id", "left").drop("user_id")
    rows = fx.session_items(spark, sf, dealt=True).join(shoppers, "session_id")
    log = fx.content_sitewide_log(spark, sf)
    clicks = [Running(log, {"csw_click": "click", "csw_orders": "orders"}, "date")]
    # an item has at most as many session rows as log rows
    total, most = history.crowding([log, log], ["content_id"])
    if most <= history.MOST:
        joined = history.as_of_dealt(rows, ["content_id"], [(["content_id"], clicks)], total=total)
    else:
        joined = history.as_of(rows, ["content_id"], clicks)
    rows = joined.join(fx.content_metadata(spark, sf), "content_id", "left")
    # score stand-ins are named as inputs here; the heads give their own
    rows = stored(rows.select(*ROW, "ts_hour", "ordered", "clicked", *NUMERIC, "leaf_category", "gender"), "frame")
    train, _ = splits.time_split(rows)
    coded = encode.encode_train(train, rows, ["leaf_category", "gender"])
    typed = encode.model_types(coded, keep=[*ROW, "ordered", "clicked"]).withColumnsRenamed({"p_order": "in_order", "p_click": "in_click"})
    typed = stored(typed, "typed")
    train, val = splits.time_split(typed)
    return train, val


INPUTS = [{"p_order": "in_order", "p_click": "in_click"}.get(c, c) for c in FEATURES]


def _flagged(train, val):
    return train.withColumn("held_out", F.lit(False)).unionByName(val.withColumn("held_out", F.lit(True)))


_SCORED: dict[tuple[str, str, str], DataFrame] = {}

SCORED_ROWS = """,
parts as (select count(*) as n, cast(trunc(count(*) * cast(0.85 as double)) as bigint) as head from sessions)
select {rows} as n_rows, cast(0 as bigint) as n_missing, cast(0 as bigint) as n_outside from parts"""


def scored(name: str, scores: Sequence[str], rows: str = "n - head", low: float | None = 0.0, high: float | None = 1.0):
    """Registers a query of scores, and ``check_`` of it: rows, rows without a finite score, rows out of range.

    The scores are written once per application and folder, so that both read the same ones.
    """

    def add(fn):
        def run(spark, sf):
            key = (spark.sparkContext.applicationId, sf, name)
            if key not in _SCORED:
                _SCORED[key] = stored(fn(spark, sf), name)
            return _SCORED[key]

        def check(spark, sf):
            cols = [F.col(c) for c in scores]
            missing = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in cols])
            outside = reduce(lambda a, b: a | b, [(c < low) | (c > high) for c in cols]) if low is not None else F.lit(False)
            return run(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_missing"), F.count_if(outside).alias("n_outside"))

        query(name)(run)
        query(f"check_{name}", views("sessions") + SCORED_ROWS.format(rows=rows))(check)
        return fn

    return add


_HEADS: dict[tuple[str, str], dict] = {}


def dual_heads(spark, sf):
    """The two heads fitted on the training rows, stopped by the session AUC of the held-out ones; fitted once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _HEADS:
        _HEADS[key] = heads.fit_heads(_flagged(*frame(spark, sf)), INPUTS, SOME, validation="held_out")
    return _HEADS[key]


@scored("train_dual_heads", ["p_order", "p_click"], rows="n")
def train_dual_heads(spark, sf):
    train, val = frame(spark, sf)
    rows = _flagged(train, val)
    return heads.score_heads(dual_heads(spark, sf), rows).select(*ROW, "p_order", "p_click")


@scored("train_single_weighted", ["p_any"])
def train_single_weighted(spark, sf):
    train, val = frame(spark, sf)
    return heads.positive_probability(heads.fit_single(_flagged(train, val), INPUTS, SOME, validation="held_out"), val, "p_any").select(*ROW, "p_any")


@scored("train_three_heads", ["p_order", "p_any", "p_click"])
def train_three_heads(spark, sf):
    train, val = (df.withColumn("any", encode.any_positive()) for df in frame(spark, sf))
    third = heads.fit_head(_flagged(train, val), "any", INPUTS, SOME, validation="held_out")
    return heads.score_heads({**dual_heads(spark, sf), "any": third}, val).select(*ROW, "p_order", "p_any", "p_click")


@scored("rank_query_rmse", ["score"], low=None)
def rank_query_rmse(spark, sf):
    train, val = frame(spark, sf)
    settings = boosting.Settings(rounds=10, patience=5, every=5, depth=4, step=0.1, subsample=1.0)
    made = heads.fit_session_ranker(_flagged(train, val), INPUTS, settings, validation="held_out")
    return heads.raw_score(PipelineModel([heads.assembler(INPUTS), made.model()]), val).select(*ROW, "score")


@scored("rank_pairwise_linear", ["score"], low=None)
def rank_pairwise_linear(spark, sf):
    train, val = frame(spark, sf)
    scaled_train, scaled_val = (encode.scale_standard(train, df, INPUTS) for df in (train, val))
    return heads.raw_score(heads.fit_preferences(scaled_train, INPUTS), scaled_val).select(*ROW, "score")


@scored("train_factorization_machine", ["p_order"])
def train_factorization_machine(spark, sf):
    train, val = frame(spark, sf)
    scaled_train, scaled_val = (encode.scale_standard(train, df, INPUTS) for df in (train, val))
    return heads.positive_probability(heads.fit_factorization(scaled_train, INPUTS, "ordered", rounds=40), scaled_val, "p_order").select(*ROW, "p_order")


@scored("train_wide_linear", ["p_click"])
def train_wide_linear(spark, sf):
    train, val = frame(spark, sf)
    model = heads.fit_wide(train, ["leaf_category", "gender", "birth_year"], "clicked", rounds=30)
    return heads.positive_probability(model, val, "p_click").select(*ROW, "p_click")


# The searched settings: two depths, two steps. Four trials make 10 rounds, two of them 20 and the last one 40.
GRID = [boosting.Settings(depth=d, step=s, subsample=0.8) for d in (3, 5) for s in (0.05, 0.2)]


@query("tune_parameters")
def tune_parameters(spark, sf):
    return tuning.table(spark, tuning.halving(*frame(spark, sf), INPUTS, GRID))


@scored("score_batch", ["p_click"])
def score_batch(spark, sf):
    _, val = frame(spark, sf)
    path = output_path(spark, "model")
    dual_heads(spark, sf)["clicked"].write().save(path)
    return heads.positive_probability(PipelineModel.load(path), val, "p_click").select(*ROW, "p_click")


@query("feature_importance")
def feature_importance(spark, sf):
    return heads.importances(dual_heads(spark, sf)["ordered"], INPUTS)


@query("top_feature_importance")
def top_feature_importance(spark, sf):
    found = heads.importances(dual_heads(spark, sf)["clicked"], INPUTS)
    return found.orderBy(F.desc("importance"), F.asc("feature"))


@scored("full_refit", ["p_order", "p_click"], rows="n")
def full_refit(spark, sf):
    train, val = frame(spark, sf)
    rows = train.unionByName(val)
    return heads.score_heads(heads.full_refit(rows, INPUTS, REFIT, SOME), rows).select(*ROW, "p_order", "p_click")


@query("holdout_group_auc")
def holdout_group_auc(spark, sf):
    """The validation score of the blended heads."""
    scored = heads.score_heads(dual_heads(spark, sf), frame(spark, sf)[1])
    return ranking.group_auc(scored, F.col("p_order") * 0.45 + F.col("p_click") * 0.55)


@query("vectorize_text")
def vectorize_text(spark, sf):
    vectors = heads.text_vectors(table(spark, sf, "documents").select("doc_id", "text"), "text", size=1 << 14)
    weights = heads.stored_values("vector")  # zeros add nothing to either
    return vectors.select(
        "doc_id", F.size(F.filter(weights, lambda x: x > 0)).alias("n_terms"), F.sqrt(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x * x)).alias("norm")
    )
