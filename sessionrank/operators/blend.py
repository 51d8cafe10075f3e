"""Score blends and the search for their weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrank.operators.packed import PACKED_ROWS
from sessionrank.operators.ranking import group_auc_of_all

# Fixed value: weight of the ordered head in the final blend.
FINAL_WEIGHT = 0.45


def two_heads(weight: float | Column = FINAL_WEIGHT, p_order: str = "p_order", p_click: str = "p_click") -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return w * F.col(p_order) + (F.lit(1.0) - w) * F.col(p_click)


def power(weight: float, a: float, b: float, p_order: str = "p_order", p_click: str = "p_click") -> Column:
    return F.lit(weight) * F.pow(p_order, F.lit(a)) + F.lit(1.0 - weight) * F.pow(p_click, F.lit(b))


def three_heads(w_order: float | Column, w_any: float | Column, w_click: float | Column) -> Column:
    """Blend of ordered, ordered-or-clicked and clicked scores; weights sum to 1."""
    o, a, c = (w if isinstance(w, Column) else F.lit(w) for w in (w_order, w_any, w_click))
    return o * F.col("p_order") + a * F.col("p_any") + c * F.col("p_click")


def grid(start: float, stop: float, points: int) -> list[float]:
    return [round(start + (stop - start) * i / (points - 1), 10) for i in range(points)]


def _two(o, c, w):
    return w * o + (1.0 - w) * c


def _power(o, c, w, a, b):
    return w * o**a + (1.0 - w) * c**b


def _three(o, any_, c, wo, wa, wc):
    return wo * o + wa * any_ + wc * c


def score_weights(df: DataFrame, weights: Sequence[float], hot_rows: int = PACKED_ROWS) -> DataFrame:
    """Ranking score of every two-head weight."""
    return group_auc_of_all(df, ["p_order", "p_click"], [(w,) for w in weights], ["w"], _two, hot_rows=hot_rows)


def best(scored: DataFrame, *by: str) -> DataFrame:
    """The best candidate; the smallest ones on ties."""
    return scored.orderBy(F.desc("score"), *[F.asc(c) for c in by]).limit(1)


def best_weight(df: DataFrame, weights: Sequence[float], hot_rows: int = PACKED_ROWS) -> DataFrame:
    """The best two-head weight; the first on ties."""
    return best(score_weights(df, weights, hot_rows), "w")


def score_powers(df: DataFrame, candidates: Sequence[tuple[float, float, float]], hot_rows: int = PACKED_ROWS) -> DataFrame:
    """Ranking score of every (w, a, b) of the power blend w * ordered^a + (1 - w) * clicked^b."""
    return group_auc_of_all(df, ["p_order", "p_click"], candidates, ["w", "a", "b"], _power, hot_rows=hot_rows)


def simplex(step: float) -> list[tuple[float, float, float]]:
    """Three weights on a grid that sum to 1, none negative."""
    n = round(1 / step)
    return [(round(i * step, 10), round(j * step, 10), round((n - i - j) * step, 10)) for i in range(n + 1) for j in range(n + 1 - i)]


# Bounds of the ordered and the ordered-or-clicked weight in the three-head search.
ORDERED_BOUNDS = (0.3, 0.7)
ANY_BOUNDS = (0.1, 0.7)


def bounded_simplex(step: float = 0.1) -> list[tuple[float, float, float]]:
    """The part of the grid that is searched for the best three weights."""
    low, high = ORDERED_BOUNDS
    return [c for c in simplex(step) if low <= c[0] <= high and ANY_BOUNDS[0] <= c[1] <= ANY_BOUNDS[1]]


def score_simplex(df: DataFrame, candidates: Sequence[tuple[float, float, float]], hot_rows: int = PACKED_ROWS) -> DataFrame:
    """Ranking score of every three-head blend among the candidates."""
    return group_auc_of_all(df, ["p_order", "p_any", "p_click"], candidates, ["w_order", "w_any", "w_click"], _three, hot_rows=hot_rows)
