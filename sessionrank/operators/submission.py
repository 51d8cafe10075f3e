"""Item lists per session: truth, prediction, and checks of a prediction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrank.operators.ordering import HOT_ROWS
from sessionrank.operators.ranking import rank_in_session

# Items per piece when a list is put together in two steps.
PIECE = 10_000


def _listed(df: DataFrame, session: str, place: str, item: str, out: str) -> DataFrame:
    """Items in order of place as one string: pieces of fixed size first, then the pieces."""
    piece = df.select(session, place, item, F.floor((F.col(place) - 1) / PIECE).alias("_piece"))
    pieces = piece.groupBy(session, "_piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, F.col(item).cast("string").alias("i")))), lambda x: x["i"]), " ").alias("_text")
    )
    return pieces.groupBy(session).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_text"))), lambda x: x["_text"]), " ").alias(out)
    )


def prediction_lists(df: DataFrame, score: str | Column, session: str = "session_id", item: str = "content_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(session, prediction): items by score, best first, as one string.

    A task sorts at most one piece of a list; only the finished text of a session, which
    the format asks for, comes together in one row.
    """
    ranked = rank_in_session(df, score, session, item, "_rank", hot_rows)
    return _listed(ranked, session, "_rank", item, "prediction")


def solution_lists(df: DataFrame, session: str = "session_id", item: str = "content_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(session, ordered_items, clicked_items, all_items), items ascending, empty text for none."""
    ranked = rank_in_session(df, F.lit(0), session, item, "_rank", hot_rows)
    piece = ranked.withColumn("_piece", F.floor((F.col("_rank") - 1) / PIECE))
    names = {"ordered_items": F.col("ordered") == 1, "clicked_items": F.col("clicked") == 1, "all_items": F.lit(True)}

    def text(condition: Column, name: str) -> Column:
        cell = F.when(condition, F.struct("_rank", F.col(item).cast("string").alias("i")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["i"]), " ").alias(name)

    pieces = piece.groupBy(session, "_piece").agg(*[text(c, n) for n, c in names.items()])
    return pieces.groupBy(session).agg(*[_joined_pieces(n) for n in names])


def _joined_pieces(name: str) -> Column:
    """Texts of a session's pieces in order; pieces without text add nothing."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_piece", name))), lambda x: x[name])
    return F.array_join(F.filter(texts, lambda t: t != ""), " ").alias(name)


def check(submission: DataFrame, expected: DataFrame, session: str = "session_id") -> DataFrame:
    """One row: session counts, missing and unexpected sessions, repeated sessions, right columns."""
    mine = submission.groupBy(session).agg(F.count(F.lit(1)).alias("n"))
    theirs = expected.select(session).distinct()
    sides = mine.select(session, "n", F.lit(0).alias("due")).unionByName(theirs.select(session, F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("due")))
    per_session = sides.groupBy(session).agg(F.sum("n").alias("n"), F.max("due").alias("due"))
    return per_session.agg(
        F.sum("n").alias("n_rows"),
        F.sum("due").alias("n_expected"),
        F.count_if((F.col("n") == 0) & (F.col("due") == 1)).alias("n_missing"),
        F.count_if((F.col("n") > 0) & (F.col("due") == 0)).alias("n_unexpected"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
    ).withColumn("columns_ok", F.lit(submission.columns == [session, "prediction"]))


def length_stats(submission: DataFrame, column: str = "prediction") -> DataFrame:
    """Sessions, and mean, shortest and longest list."""
    n = F.when(F.trim(column) == "", 0).otherwise(F.size(F.split(F.trim(column), r"\s+"))).cast("bigint")
    return submission.select(n.alias("n")).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg("n").alias("mean_items"), F.min("n").alias("min_items"), F.max("n").alias("max_items")
    )


def item_positions(lists: DataFrame, column: str, session: str = "session_id") -> DataFrame:
    """List to (session, position, item) rows, positions from 1."""
    return lists.select(session, F.posexplode(F.filter(F.split(column, r"\s+"), lambda t: t != "")).alias("_p", "item")).select(
        session, (F.col("_p") + 1).cast("bigint").alias("position"), "item"
    )


def score_summary(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Per score: smallest, largest and mean value."""
    cells = [
        F.struct(F.lit(name).alias("score_name"), F.min(c).alias("min_score"), F.max(c).alias("max_score"), F.avg(c).alias("mean_score"))
        for name, c in columns.items()
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
