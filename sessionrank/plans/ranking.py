"""Ranking, metrics, blends and submissions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionrank.operators import blend, ranking, splits, submission
from sessionrank.plans.registry import query, views
from sessionrank.sources import fixtures as fx

BLEND = "0.45::double * p_order + (1::double - 0.45::double) * p_click"


def _ranked_sql(score=BLEND, by=""):
    return f"""{views("sessions")},
    r as (select *, count(*) over (partition by session_id) as n,
                 row_number() over (partition by session_id order by {score} desc, content_id) as rank from sessions)"""


AUC_SQL = """a as (select session_id, n,
      case when sum(ordered) between 1 and n - 1 then (sum(ordered * (n - rank + 1)) - sum(ordered) * (sum(ordered) + 1) / 2.0::double)
           / (sum(ordered) * (n - sum(ordered)))::double end as ordered_auc,
      case when sum(clicked) between 1 and n - 1 then (sum(clicked * (n - rank + 1)) - sum(clicked) * (sum(clicked) + 1) / 2.0::double)
           / (sum(clicked) * (n - sum(clicked)))::double end as clicked_auc
    from r group by session_id, n)"""


def _scored(spark, sf):
    return fx.sessions(spark, sf)


@query("rank_in_session", _ranked_sql() + " select session_id, content_id, rank from r")
def rank_in_session(spark, sf):
    return ranking.rank_in_session(_scored(spark, sf), blend.two_heads()).select("session_id", "content_id", "rank")


@query("topk_items_per_session", _ranked_sql() + " select session_id, content_id, rank from r where rank <= 3")
def topk_items_per_session(spark, sf):
    rows = _scored(spark, sf).withColumn("score", blend.two_heads())
    return ranking.top_items(rows, 3, "score").select("session_id", "content_id", "rank")


@query("metric_session_auc", f"{_ranked_sql()}, {AUC_SQL} select session_id, n as n_items, round(ordered_auc, 9) as ordered_auc, round(clicked_auc, 9) as clicked_auc from a")
def metric_session_auc(spark, sf):
    return ranking.session_auc(_scored(spark, sf), blend.two_heads()).select(
        "session_id", "n_items", F.round("ordered_auc", 9).alias("ordered_auc"), F.round("clicked_auc", 9).alias("clicked_auc")
    )


MEAN_SQL = """round(coalesce(avg(ordered_auc), 0.5), 9) as ordered_auc, round(coalesce(avg(clicked_auc), 0.5), 9) as clicked_auc,
    count(ordered_auc) as n_ordered, count(clicked_auc) as n_clicked,
    round(0.7::double * coalesce(avg(ordered_auc), 0.5) + 0.3::double * coalesce(avg(clicked_auc), 0.5), 9) as score"""


def _rounded(df, *by):
    return df.select(*by, *[F.round(c, 9).alias(c) for c in ("ordered_auc", "clicked_auc")], "n_ordered", "n_clicked", F.round("score", 9).alias("score"))


@query("metric_group_auc", f"{_ranked_sql()}, {AUC_SQL} select {MEAN_SQL} from a")
def metric_group_auc(spark, sf):
    return _rounded(ranking.group_auc(_scored(spark, sf), blend.two_heads()))


@query("metric_group_auc_lists", f"{_ranked_sql()}, {AUC_SQL} select {MEAN_SQL} from a")
def metric_group_auc_lists(spark, sf):
    rows = _scored(spark, sf)
    truth, predicted = submission.solution_lists(rows), submission.prediction_lists(rows, blend.two_heads())
    return _rounded(ranking.score_lists(truth, predicted, strict=False))


# a prediction with faults: sessions of three items lose their largest item, those of four gain an unknown one
FAULTY = """case when n = 3 then [x for x in items if x <> list_max(items)] when n = 4 then list_append(items, -1) else items end"""


def _faulty(rows):
    sized = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("content_id").alias("top"))
    kept = rows.join(sized, "session_id").where("not (n = 3 and content_id = top)").select("session_id", "content_id", "p_order", "p_click")
    extra = sized.where("n = 4").select("session_id", F.lit(-1).cast("bigint").alias("content_id"), F.lit(-1.0).alias("p_order"), F.lit(-1.0).alias("p_click"))
    return kept.unionByName(extra)


@query("metric_validate_lists", f"""{views("sessions")}
    select session_id, case when count(*) = 3 then 1 else 0 end as n_missing, case when count(*) = 4 then 1 else 0 end as n_extra
    from sessions group by session_id having count(*) in (3, 4)""")
def metric_validate_lists(spark, sf):
    rows = _scored(spark, sf)
    predicted = submission.prediction_lists(_faulty(rows), blend.two_heads())
    return ranking.list_violations(submission.solution_lists(rows), predicted).select(
        "session_id", F.col("n_missing").cast("int").alias("n_missing"), F.col("n_extra").cast("int").alias("n_extra")
    )


@query("except_items", f"""{views("sessions")}, s as (select session_id, count(*) as n, max(content_id) as top from sessions group by 1)
    select session_id, cast(top as varchar) as item, 'missing' as side from s where n = 3
    union all select session_id, '-1', 'extra' from s where n = 4""")
def except_items(spark, sf):
    rows = _scored(spark, sf)
    predicted = submission.prediction_lists(_faulty(rows), blend.two_heads())
    lined = ranking.list_rows(submission.solution_lists(rows), predicted)
    side = F.when(F.col("rank").isNull(), "missing").when(F.col("in_truth") == 0, "extra")
    return lined.select("session_id", "item", side.alias("side")).where("side is not null")


@query("metric_group_map", f"""{_ranked_sql()},
    g as (select *, case when ordered = 1 then 2 when clicked = 1 then 1 else 0 end as grade from r),
    c as (select *, sum(grade) over (partition by session_id order by rank) as hits from g),
    p as (select session_id, sum(case when grade > 0 then hits::double / rank else 0 end) / sum(grade) as ap from c group by 1 having sum(grade) > 0)
    select round(coalesce(avg(ap), 0), 9) as group_map, count(*) as n_sessions from p""")
def metric_group_map(spark, sf):
    per_session = ranking.graded_precision(_scored(spark, sf), blend.two_heads())
    return per_session.agg(F.round(F.coalesce(F.avg("average_precision"), F.lit(0.0)), 9).alias("group_map"), F.count("*").alias("n_sessions"))


GLOBAL_AUC_SQL = """select '{label}' as label, (select (sum(rk) filter ({label} = 1) - count(*) filter ({label} = 1) * (count(*) filter ({label} = 1) + 1) / 2.0::double)
      / (count(*) filter ({label} = 1) * count(*) filter ({label} = 0))::double
    from (select {label}, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0::double as rk from sessions)) as auc"""


@query("metric_global_auc", f"""{views("sessions")}, g as ({GLOBAL_AUC_SQL.format(label="ordered", score="p_order")} union all
    {GLOBAL_AUC_SQL.format(label="clicked", score="p_click")}) select label, round(auc, 9) as auc from g""")
def metric_global_auc(spark, sf):
    rows = _scored(spark, sf)
    both = ranking.global_auc(rows, "p_order", "ordered").unionByName(ranking.global_auc(rows, "p_click", "clicked"))
    return both.select("label", F.round("auc", 9).alias("auc"))


@query("metric_combined", f"""{views("sessions")}, g as ({GLOBAL_AUC_SQL.format(label="ordered", score="p_order")} union all
    {GLOBAL_AUC_SQL.format(label="clicked", score="p_click")}) select round(sum(case when label = 'ordered' then 0.7::double else 0.3::double end * auc), 9) as combined from g""")
def metric_combined(spark, sf):
    rows = _scored(spark, sf)
    both = ranking.global_auc(rows, "p_order", "ordered").unionByName(ranking.global_auc(rows, "p_click", "clicked"))
    weight = F.when(F.col("label") == "ordered", ranking.ORDERED_WEIGHT).otherwise(ranking.CLICKED_WEIGHT)
    return both.agg(F.round(F.sum(weight * F.col("auc")), 9).alias("combined"))


@query("metric_precision_recall", f"""{views("sessions")}, c as (select cls, count(*) filter (pred = cls and clicked = cls) as hit, count(*) filter (pred = cls) as said,
      count(*) filter (clicked = cls) as support from (select clicked, case when p_order * 10 >= 0.5 then 1 else 0 end as pred from sessions), (values (0), (1)) v(cls) group by cls),
    p as (select cls, case when said > 0 then hit / said::double else 0 end as pr, case when support > 0 then hit / support::double else 0 end as rc, support from c)
    select cls as class, round(pr, 9) as precision, round(rc, 9) as recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 9) as f1, support from p""")
def metric_precision_recall(spark, sf):
    table = ranking.precision_recall(_scored(spark, sf), F.col("p_order") * 10, "clicked")
    return table.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("blend_two_heads", f"{views('sessions')} select session_id, content_id, {BLEND} as score from sessions")
def blend_two_heads(spark, sf):
    return _scored(spark, sf).select("session_id", "content_id", blend.two_heads().alias("score"))


@query("blend_power", f"{views('sessions')} select session_id, content_id, round(0.6::double * pow(p_order, 1.5) + 0.4::double * pow(p_click, 0.75), 9) as score from sessions")
def blend_power(spark, sf):
    return _scored(spark, sf).select("session_id", "content_id", F.round(blend.power(0.6, 1.5, 0.75), 9).alias("score"))


ANY_SQL = "greatest(p_order, p_click)"


def _three(spark, sf):
    return _scored(spark, sf).withColumn("p_any", F.greatest("p_order", "p_click"))


@query("blend_three_heads", f"{views('sessions')} select session_id, content_id, 0.5::double * p_order + 0.3::double * {ANY_SQL} + 0.2::double * p_click as score from sessions")
def blend_three_heads(spark, sf):
    return _three(spark, sf).select("session_id", "content_id", blend.three_heads(0.5, 0.3, 0.2).alias("score"))


WEIGHTS = blend.grid(0.5, 0.9, 41)


def _grid_sql(weights):
    values = ", ".join(f"({w!r}::double)" for w in weights)
    return f"""{views("sessions")},
    r as (select s.*, w, count(*) over (partition by w, session_id) as n,
                 row_number() over (partition by w, session_id order by w * p_order + (1::double - w) * p_click desc, content_id) as rank
          from sessions s, (values {values}) v(w)),
    {AUC_SQL.replace("select session_id, n,", "select w, session_id, n,").replace("group by session_id, n", "group by w, session_id, n")},
    m as (select w, {MEAN_SQL} from a group by w)"""


@query("cross_join_weight_grid", _grid_sql([0.1, 0.3, 0.45, 0.7, 0.9]) + " select * from m")
def cross_join_weight_grid(spark, sf):
    return _rounded(blend.score_weights(_scored(spark, sf), [0.1, 0.3, 0.45, 0.7, 0.9]), "w")


@query("search_blend_weight", _grid_sql(WEIGHTS) + " select * from m order by score desc, w limit 1")
def search_blend_weight(spark, sf):
    return _rounded(blend.best_weight(_scored(spark, sf), WEIGHTS), "w")


def _candidates_sql(names, candidates, score):
    """Mean session AUCs of blends given as rows of values; ``score`` is written over p_order, p_any, p_click and the names."""
    values = ", ".join("(" + ", ".join(f"{v!r}::double" for v in c) + ")" for c in candidates)
    by = ", ".join(names)
    return f"""{views("sessions")},
    s as (select session_id, content_id, ordered, clicked, p_order, p_click, {ANY_SQL} as p_any from sessions),
    r as (select s.*, {by}, count(*) over (partition by {by}, session_id) as n,
                 row_number() over (partition by {by}, session_id order by {score} desc, content_id) as rank
          from s, (values {values}) v({by})),
    {AUC_SQL.replace("select session_id, n,", f"select {by}, session_id, n,").replace("group by session_id, n", f"group by {by}, session_id, n")},
    m as (select {by}, {MEAN_SQL} from a group by {by})"""


SIMPLEX, THREE_SQL = ["w_order", "w_any", "w_click"], "w_order * p_order + w_any * p_any + w_click * p_click"


@query("search_blend_simplex", _candidates_sql(SIMPLEX, blend.simplex(0.1), THREE_SQL) + " select * from m")
def search_blend_simplex(spark, sf):
    """All three-head blends on the grid."""
    return _rounded(blend.score_simplex(_three(spark, sf), blend.simplex(0.1)), *SIMPLEX)


@query("search_blend_simplex_best", _candidates_sql(SIMPLEX, blend.bounded_simplex(), THREE_SQL) + " select * from m order by score desc, w_order, w_any, w_click limit 1")
def search_blend_simplex_best(spark, sf):
    """The best three-head blend within the searched bounds."""
    return blend.best(_rounded(blend.score_simplex(_three(spark, sf), blend.bounded_simplex()), *SIMPLEX), *SIMPLEX)


POWERS = [(w, a, b) for w in (0.5, 0.65, 0.8, 0.95) for a in (0.5, 1.0, 1.5) for b in (0.5, 1.0, 1.5)]


@query("search_blend_power", _candidates_sql(["w", "a", "b"], POWERS, "w * pow(p_order, a) + (1::double - w) * pow(p_click, b)") + " select * from m order by score desc, w, a, b limit 1")
def search_blend_power(spark, sf):
    """The best weight and exponents of the power blend by the ranking score."""
    return blend.best(_rounded(blend.score_powers(_scored(spark, sf), POWERS), "w", "a", "b"), "w", "a", "b")


@query("build_submission", f"{views('sessions')} select session_id, string_agg(cast(content_id as varchar), ' ' order by {BLEND} desc, content_id) as prediction from sessions group by 1")
def build_submission(spark, sf):
    return submission.prediction_lists(_scored(spark, sf), blend.two_heads())


SOLUTION_SQL = f"""{views('sessions')} select session_id,
    coalesce(string_agg(cast(content_id as varchar), ' ' order by content_id) filter (ordered = 1), '') as ordered_items,
    coalesce(string_agg(cast(content_id as varchar), ' ' order by content_id) filter (clicked = 1), '') as clicked_items,
    string_agg(cast(content_id as varchar), ' ' order by content_id) as all_items from sessions group by 1"""


@query("agg_session_solution", SOLUTION_SQL)
def agg_session_solution(spark, sf):
    return submission.solution_lists(_scored(spark, sf))


@query("join_solution_submission", f"""{views('sessions')} select session_id, string_agg(cast(content_id as varchar), ' ' order by content_id) as all_items,
    string_agg(cast(content_id as varchar), ' ' order by {BLEND} desc, content_id) as prediction from sessions group by 1 having count(*) > 1""")
def join_solution_submission(spark, sf):
    rows = _scored(spark, sf)
    several = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    predicted = submission.prediction_lists(rows.join(several, "session_id", "left_semi"), blend.two_heads())
    return submission.solution_lists(rows).select("session_id", "all_items").join(predicted, "session_id")


@query("check_submission", f"""{views('sessions')}, s as (select session_id, count(*) as n from sessions group by 1)
    select count(*) filter (n > 1) + 1 as n_rows, count(*) as n_expected, count(*) filter (n = 1) as n_missing, 1 as n_unexpected, 0 as n_repeated, true as columns_ok from s""")
def check_submission(spark, sf):
    rows = _scored(spark, sf)
    several = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a submission without the one-item sessions and with one session nobody asked for
    extra = rows.select(F.lit(-1).cast("bigint").alias("session_id"), F.lit("0").alias("prediction")).distinct()
    predicted = submission.prediction_lists(rows.join(several, "session_id", "left_semi"), blend.two_heads()).unionByName(extra)
    return submission.check(predicted, rows).select(
        "n_rows", "n_expected", "n_missing", F.col("n_unexpected").cast("int").alias("n_unexpected"), F.col("n_repeated").cast("int").alias("n_repeated"), "columns_ok"
    )


@query("metric_group_map_lists", f"""{views("sessions")}, r as (select *, case when ordered = 1 then 2 when clicked = 1 then 1 else 0 end as grade,
      row_number() over (partition by session_id order by {BLEND} desc, content_id) as rank from sessions),
    h as (select *, sum(grade) over (partition by session_id order by rank) as hits from r),
    p as (select session_id, sum(case when grade > 0 then hits / rank::double else 0 end) / sum(grade) as ap from h group by 1 having sum(grade) > 0)
    select round(coalesce(avg(ap), 0), 9) as group_map, count(*) as n_sessions from p""")
def metric_group_map_lists(spark, sf):
    """Graded precision of a submission in list form against the lists of the solution."""
    rows = _scored(spark, sf)
    scored = ranking.graded_precision_lists(submission.solution_lists(rows), submission.prediction_lists(rows, blend.two_heads()))
    return scored.select(F.round("group_map", 9).alias("group_map"), "n_sessions")


@query("agg_list_length_stats", f"""{views('sessions')} select count(*) as n_sessions, round(avg(n), 9) as mean_items, min(n) as min_items, max(n) as max_items
    from (select session_id, count(*) as n from sessions group by 1)""")
def agg_list_length_stats(spark, sf):
    lists = submission.prediction_lists(_scored(spark, sf), blend.two_heads())
    return submission.length_stats(lists).withColumn("mean_items", F.round("mean_items", 9))


@query("array_explode_positions", _ranked_sql() + " select session_id, rank as position, cast(content_id as varchar) as item from r")
def array_explode_positions(spark, sf):
    return submission.item_positions(submission.prediction_lists(_scored(spark, sf), blend.two_heads()), "prediction")


@query("array_join_string", f"""{views('sessions')} select user_id, string_agg(cast(session_id as varchar), ' ' order by session_id) as user_sessions
    from (select distinct user_id, session_id from sessions) group by 1""")
def array_join_string(spark, sf):
    pairs = _scored(spark, sf).select("user_id", "session_id").distinct()
    return submission.prediction_lists(pairs, F.lit(0), "user_id", "session_id").withColumnRenamed("prediction", "user_sessions")


MODELS = [(0.0, "clicked_head"), (0.45, "blend"), (1.0, "ordered_head")]


@query("select_best_model", f"""{views("sessions")},
    o as (select *, row_number() over (order by ts_hour nulls first, session_id, content_id) as place, count(*) over () as total from sessions),
    h as (select * from o where place > trunc(total * 0.85::double)),
    r as (select h.*, w, model, count(*) over (partition by w, session_id) as n,
                 row_number() over (partition by w, session_id order by w * p_order + (1::double - w) * p_click desc, content_id) as rank
          from h, (values {", ".join(f"({w!r}::double, '{m}')" for w, m in MODELS)}) v(w, model)),
    {AUC_SQL.replace("select session_id, n,", "select model, session_id, n,").replace("group by session_id, n", "group by model, session_id, n")},
    m as (select model, {MEAN_SQL} from a group by model) select model, score as holdout from m order by holdout desc, model limit 1""")
def select_best_model(spark, sf):
    """The model with the best group AUC on the last 15 % of the rows by time."""
    _, held = splits.time_split(_scored(spark, sf))
    scores = blend.score_weights(held, [w for w, _ in MODELS])
    names = F.create_map(*[F.lit(x) for pair in MODELS for x in pair])
    results = scores.select(F.get(F.map_values(F.map_filter(names, lambda k, _: k == F.col("w"))), F.lit(0)).alias("model"), F.round("score", 9).alias("holdout"))
    return ranking.best_of(results, "model", "holdout")


@query("export_row_scores", f"{views('sessions')} select session_id, p_order as ordered, p_click as clicked from sessions")
def export_row_scores(spark, sf):
    return _scored(spark, sf).select("session_id", F.col("p_order").alias("ordered"), F.col("p_click").alias("clicked"))


@query("agg_score_summary", f"""{views('sessions')} select 'ordered' as score_name, min(p_order) as min_score, max(p_order) as max_score, round(avg(p_order), 9) as mean_score from sessions
    union all select 'clicked', min(p_click), max(p_click), round(avg(p_click), 9) from sessions""")
def agg_score_summary(spark, sf):
    table = submission.score_summary(_scored(spark, sf), {"ordered": "p_order", "clicked": "p_click"})
    return table.withColumn("mean_score", F.round("mean_score", 9))
