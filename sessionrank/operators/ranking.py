"""Ranking within sessions and the metrics of a ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrank.functions.text import tokens
from sessionrank.operators.ordering import HOT_ROWS, range_running, rank_within, running_within
from sessionrank.operators.packed import PACKED_ROWS, bounds, flat, pack
from sessionrank.session import durable

# Weights of the two labels in the final score, and the AUC of no evidence.
ORDERED_WEIGHT = 0.7
CLICKED_WEIGHT = 0.3
CHANCE = 0.5


class RankingError(ValueError):
    """A submission that cannot be scored."""


def order_of(score: str | Column, item: str) -> list[Column]:
    return [(F.col(score) if isinstance(score, str) else score).desc(), F.col(item).asc()]


def rank_in_session(df: DataFrame, score: str | Column, session: str = "session_id", item: str = "content_id", out: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based rank by score, best first; equal scores by item."""
    return rank_within(df, [session], order_of(score, item), out, hot_rows)


def top_items(df: DataFrame, k: int, score: str, session: str = "session_id", item: str = "content_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    return rank_in_session(df, score, session, item, "rank", hot_rows).where(F.col("rank") <= k)


def _auc(n: Column, pos: Column, rank_sum: Column) -> Column:
    """AUC from the number of items, of positives, and the positives' rank sum (rank 1 is best).

    Null for a session with only positives or only negatives.
    """
    gain = pos * (n + 1) - rank_sum - pos * (pos + 1) / 2
    return F.when((pos > 0) & (pos < n), gain / (pos * (n - pos)))


def auc_of_ranks(ranked: DataFrame, keys: Sequence[str], labels: Sequence[str], rank: str = "rank") -> DataFrame:
    """Per group: item count and AUC of each label. Plain sums, so hot groups are pre-aggregated."""
    aggs = [F.count(F.lit(1)).alias("n_items")]
    for c in labels:
        aggs += [F.sum(c).cast("bigint").alias(f"_p_{c}"), F.sum(F.col(c) * F.col(rank)).cast("bigint").alias(f"_r_{c}")]
    sums = ranked.groupBy(*keys).agg(*aggs)
    return sums.select(*keys, "n_items", *[_auc(F.col("n_items"), F.col(f"_p_{c}"), F.col(f"_r_{c}")).alias(f"{c}_auc") for c in labels])


def session_auc(df: DataFrame, score: str | Column, labels: Sequence[str] = ("ordered", "clicked"), session: str = "session_id", item: str = "content_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """AUC of every session and label; null where a session cannot be scored."""
    return auc_of_ranks(rank_in_session(df, score, session, item, hot_rows=hot_rows), [session], labels)


def mean_auc(per_session: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = ("ordered", "clicked")) -> DataFrame:
    """Mean AUC per label, sessions counted, and the weighted score."""
    means = [F.coalesce(F.avg(f"{c}_auc"), F.lit(CHANCE)).alias(f"{c}_auc") for c in labels]
    counts = [F.count(f"{c}_auc").alias(f"n_{c}") for c in labels]
    weights = {"ordered": ORDERED_WEIGHT, "clicked": CLICKED_WEIGHT}
    score = sum((F.lit(weights.get(c, 1.0 / len(labels))) * F.col(f"{c}_auc") for c in labels[1:]), F.lit(weights.get(labels[0], 1.0 / len(labels))) * F.col(f"{labels[0]}_auc"))
    return per_session.groupBy(*by).agg(*means, *counts).withColumn("score", score)


def group_auc(df: DataFrame, score: str | Column, session: str = "session_id", item: str = "content_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ranking score: mean session AUCs, 0.7 for ordered and 0.3 for clicked."""
    return mean_auc(session_auc(df, score, session=session, item=item, hot_rows=hot_rows))


def session_aucs(score: np.ndarray, labels: np.ndarray, owner: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """AUC of every (label, session) from one score of every row; NaN where a session has rows of one kind only.

    Rows stand by session and, inside one, in item order, so that a stable sort breaks ties by item.
    """
    order = np.lexsort((-score, owner))
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score)) - first[owner] + 1
    out = np.full((len(labels), len(sizes)), np.nan)
    for i, y in enumerate(labels):
        pos = np.bincount(owner, y, len(sizes))
        gain = pos * (sizes + 1) - np.bincount(owner, y * rank, len(sizes)) - pos * (pos + 1) / 2
        both = (pos > 0) & (pos < sizes)
        out[i, both] = gain[both] / (pos * (sizes - pos))[both]
    return out


def group_auc_of_all(
    df: DataFrame, scores: Sequence[str], candidates: Sequence[tuple[float, ...]], by: Sequence[str], blend: Callable[..., object],
    session: str = "session_id", item: str = "content_id", hot_rows: int = PACKED_ROWS,
) -> DataFrame:
    """The ranking score of many blends in one pass over packed sessions.

    ``blend`` gives the score of a row from its score columns and the fields of a candidate; it
    is called with numpy arrays and numbers for packed sessions, and with columns for the rows
    of sessions that are too large to pack. Sessions that no label can score are left out before
    anything is multiplied. Missing scores rank last. A task gives two numbers a label and
    candidate, whatever its rows.
    """
    labels = ["ordered", "clicked"]
    able = reduce(lambda a, b: a | b, [(F.max(c) > 0) & (F.min(c) == 0) for c in labels])
    cold, hot = pack(df, [*scores, *labels], session, item, hot_rows, able, written=False)
    parts = []
    fields = [f"{c}_{k}" for c in labels for k in ("sum", "n")]
    if cold is not None:
        schema = pa.schema([("i", pa.int32()), *[(f, pa.float64()) for f in fields]])

        def run(batches):
            sums = np.zeros((len(candidates), len(labels), 2))
            for batch in batches:
                at = bounds(batch.column(labels[0]))
                sizes, first = np.diff(at).astype(float), at[:-1]
                owner = np.repeat(np.arange(len(sizes)), np.diff(at))
                given = [flat(batch.column(c)) for c in scores]
                truth = np.stack([flat(batch.column(c)) for c in labels])
                for i, candidate in enumerate(candidates):
                    made = np.asarray(blend(*given, *candidate), float)
                    aucs = session_aucs(np.where(np.isnan(made), -np.inf, made), truth, owner, first, sizes)
                    sums[i, :, 0] += np.nansum(aucs, axis=1)
                    sums[i, :, 1] += np.sum(~np.isnan(aucs), axis=1)
            columns = [pa.array(np.arange(len(candidates), dtype=np.int32)), *[pa.array(sums[:, j, k]) for j in range(len(labels)) for k in range(2)]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

        parts.append(cold.select(*scores, *labels).mapInArrow(run, "i int, " + ", ".join(f"{f} double" for f in fields)))
    if hot is not None:
        cells = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(n) for n, v in zip(by, c)]) for i, c in enumerate(candidates)]))
        many = hot.select("*", cells).withColumn("_score", blend(*[F.col(c) for c in scores], *[F.col(n) for n in by]))
        ranked = range_running(many, ["i", session], [F.col("_score").desc_nulls_last(), F.col(item).asc()], {"rank": F.lit(1).cast("bigint")})
        each = auc_of_ranks(ranked, ["i", session], labels)
        parts.append(each.select("i", *[v.cast("double").alias(f"{c}_{k}") for c in labels for k, v in (("sum", F.coalesce(F.col(f"{c}_auc"), F.lit(0.0))), ("n", F.col(f"{c}_auc").isNotNull().cast("int")))]))
    total = reduce(DataFrame.unionByName, parts).groupBy("i").agg(*[F.sum(f).alias(f) for f in fields])
    listed = df.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(candidates)], "i int, " + ", ".join(f"`{n}` double" for n in by))
    found = listed.join(F.broadcast(total), "i", "left")  # one row a candidate
    means = [F.coalesce(F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n")), F.lit(CHANCE)).alias(f"{c}_auc") for c in labels]
    counts = [F.coalesce(F.col(f"{c}_n"), F.lit(0)).cast("bigint").alias(f"n_{c}") for c in labels]
    return found.select(*by, *means, *counts).withColumn("score", F.lit(ORDERED_WEIGHT) * F.col("ordered_auc") + F.lit(CLICKED_WEIGHT) * F.col("clicked_auc"))


# ---- list form: one space-separated string of items per session

def _require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise RankingError(f"{what} must contain the columns {missing}")


def list_rows(solution: DataFrame, submission: DataFrame, session: str = "session_id", written: bool = False) -> DataFrame:
    """(session, item, rank, ordered, clicked, in_truth) of the sessions found on both sides.

    The sides meet by session, each read once; the four lists become rows together, and one
    aggregation per (session, item) lines them up. ``rank`` is the position among the distinct
    predicted items; null if not predicted. ``written`` checkpoints the joined lists, a row a
    session, for callers that pass over the rows more than once.
    """
    _require(solution, [session, "ordered_items", "clicked_items", "all_items"], "solution")
    _require(submission, [session, "prediction"], "submission")
    met = solution.select(session, "ordered_items", "clicked_items", "all_items").join(submission.select(session, "prediction"), session)
    flags = ("ordered", "clicked", "in_truth")

    def cell(item: Column, rank: Column, flag: str | None) -> Column:
        return F.struct(item.alias("item"), rank.cast("bigint").alias("rank"), *[F.lit(int(c == flag)).alias(c) for c in flags])

    def cells(source: str, flag: str) -> Column:
        return F.transform(tokens(F.coalesce(F.col(source), F.lit(""))), lambda x: cell(x, F.lit(None), flag))

    predicted = F.transform(F.array_distinct(tokens(F.coalesce(F.col("prediction"), F.lit("")))), lambda x, i: cell(x, i + 1, None))
    listed = [cells(source, flag) for source, flag in zip(("ordered_items", "clicked_items", "all_items"), flags)]
    rows = (durable(met) if written else met).select(session, F.inline(F.concat(predicted, *listed)))
    return rows.groupBy(session, "item").agg(F.min("rank").alias("rank"), *[F.max(c).alias(c) for c in flags])


def list_violations(solution: DataFrame, submission: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions whose predicted and true item sets differ: missing and extra counts."""
    rows = list_rows(solution, submission, session)
    missing = F.count_if((F.col("in_truth") == 1) & F.col("rank").isNull())
    extra = F.count_if((F.col("in_truth") == 0) & F.col("rank").isNotNull())
    return rows.groupBy(session).agg(missing.alias("n_missing"), extra.alias("n_extra")).where("n_missing > 0 or n_extra > 0")


def score_lists(solution: DataFrame, submission: DataFrame, session: str = "session_id", strict: bool = True) -> DataFrame:
    """The ranking score of a submission in list form, one row.

    Sessions absent from the submission are skipped. ``strict`` raises when any session's
    predicted set is not its true set.
    """
    if strict:
        bad = list_violations(solution, submission, session).orderBy(session).take(1)
        if bad:
            row = bad[0]
            raise RankingError(f"session {row[session]}: {row['n_missing']} items missing from the prediction, {row['n_extra']} extra")
    ranked = list_rows(solution, submission, session).where("rank is not null")
    return mean_auc(auc_of_ranks(ranked, [session], ["ordered", "clicked"]))


def score(solution: DataFrame, submission: DataFrame, session: str = "session_id") -> float:
    """The ranking score as a number."""
    return score_lists(solution, submission, session).first()["score"]


def graded_precision(df: DataFrame, score: str | Column, session: str = "session_id", item: str = "content_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Average precision per session with grades: 2 for ordered, 1 for clicked only. Ungraded sessions drop out."""
    grade = F.when(F.col("ordered") > 0, 2).when(F.col("clicked") > 0, 1).otherwise(0).cast("bigint")
    ranked = running_within(df, [session], order_of(score, item), {"rank": F.lit(1).cast("bigint"), "hits": grade}, hot_rows)
    return _precision(ranked.withColumn("grade", grade), session)


def _precision(ranked: DataFrame, session: str) -> DataFrame:
    gain = F.when(F.col("grade") > 0, F.col("hits").cast("double") / F.col("rank")).otherwise(0.0)
    sums = ranked.groupBy(session).agg(F.sum(gain).alias("gain"), F.sum("grade").alias("grades"))
    return sums.where("grades > 0").select(session, (F.col("gain") / F.col("grades")).alias("average_precision"))


def graded_precision_lists(solution: DataFrame, submission: DataFrame, session: str = "session_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean graded precision of a submission in list form, 0 when nothing can be scored.

    Graded items that were not predicted still count in the denominator.
    """
    grade = F.when(F.col("ordered") > 0, 2).when(F.col("clicked") > 0, 1).otherwise(0).cast("bigint")
    rows = list_rows(solution, submission, session, written=True).withColumn("grade", grade)
    # items not predicted sort last and add nothing
    place = F.coalesce(F.col("rank"), F.lit(1 << 62))
    ranked = running_within(rows, [session], [place.asc(), F.col("item").asc()], {"hits": grade}, hot_rows)
    gain = F.when((F.col("grade") > 0) & F.col("rank").isNotNull(), F.col("hits").cast("double") / F.col("rank")).otherwise(0.0)
    sums = ranked.groupBy(session).agg(F.sum(gain).alias("gain"), F.sum("grade").alias("grades"), F.count("rank").alias("predicted"))
    per_session = sums.where("grades > 0 and predicted > 0").select((F.col("gain") / F.col("grades")).alias("ap"))
    return per_session.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("group_map"), F.count("ap").alias("n_sessions"))


# ---- metrics over all rows

def global_auc(df: DataFrame, score: str | Column, label: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """ROC AUC over all rows, equal scores counted half; one class only gives 0.5.

    Rows are first counted per distinct score, so only that histogram is ordered.
    """
    value = F.col(score) if isinstance(score, str) else score
    histogram = df.select(value.alias("_s"), F.col(label).cast("bigint").alias("_y")).groupBy("_s").agg(
        F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")
    )
    below = running_within(histogram, [], [F.col("_s").asc()], {"_upto": F.col("neg")}, hot_rows)
    pairs = F.sum(F.col("pos").cast("double") * (F.col("_upto") - F.col("neg") / 2))
    totals = below.agg(pairs.alias("wins"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    auc = F.coalesce(F.try_divide(F.col("wins"), F.col("p") * F.col("n")), F.lit(CHANCE))
    return totals.select(F.lit(label).alias("label"), auc.alias("auc"))


def precision_recall(df: DataFrame, score: str | Column, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class at a threshold."""
    value = F.col(score) if isinstance(score, str) else score
    predicted, actual = (value >= threshold).cast("int"), F.col(label).cast("int")
    cells = [
        F.struct(
            F.lit(c).alias("class"),
            F.count_if((predicted == c) & (actual == c)).cast("double").alias("hit"),
            F.count_if(predicted == c).cast("double").alias("said"),
            F.count_if(actual == c).alias("support"),
        )
        for c in (0, 1)
    ]
    rows = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def best_of(results: DataFrame, name: str, score: str) -> DataFrame:
    """The row with the highest score; the smallest name on ties."""
    return results.orderBy(F.desc(score), F.asc(name)).limit(1)
