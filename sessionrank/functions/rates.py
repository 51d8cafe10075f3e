"""Rates, ratios, buckets and price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column | str) -> Column:
    """To double; text that is no number becomes null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def smoothed(numerator: Column, denominator: Column, alpha: float = 1.0) -> Column:
    return (numerator + F.lit(alpha)) / (denominator + F.lit(alpha))


def clipped_ratio(numerator: Column, denominator: Column, floor: float = 1e-8) -> Column:
    return numerator / F.greatest(denominator, F.lit(floor))


def both_sides_ratio(numerator: Column, denominator: Column, eps: float = 1e-6) -> Column:
    return (F.coalesce(num(numerator), F.lit(0.0)) + F.lit(eps)) / (F.coalesce(num(denominator), F.lit(0.0)) + F.lit(eps))


def finite_or(c: Column, default: float | None = 0.0) -> Column:
    """Null, NaN and infinities become the default."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(default).cast("double")).otherwise(c)


def ratio_or(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def standard_score(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std, 0 where the spread is 0 or unknown."""
    return finite_or(F.try_divide(value - mean, std))


def discount_pct(original: Column, selling: Column) -> Column:
    """Percent off the original price, which is never taken below the selling price."""
    base = F.when(original < selling, selling).otherwise(original)
    return F.coalesce(F.when(base > 0, F.try_divide(base - selling, base)), F.lit(0.0)) * F.lit(100.0)


def discount_pct_raw(original: Column, selling: Column) -> Column:
    return F.try_divide(original - selling, original) * F.lit(100.0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tenure_bucket(days: Column) -> Column:
    return F.when(days <= 30, "new").when(days <= 365, "regular").otherwise("loyal")


def price_bucket(price: Column) -> Column:
    return F.when(price <= 50, "low").when(price <= 200, "medium").when(price <= 500, "high").otherwise("premium")


def rating_bucket(rating: Column) -> Column:
    return F.when(rating >= 4.5, "excellent").when(rating >= 4.0, "good").when(rating >= 3.0, "average").otherwise("poor")


def ctr_transforms(ctr: Column) -> dict[str, Column]:
    clipped = F.greatest(F.coalesce(num(ctr), F.lit(0.0)), F.lit(0.0))
    return {"ctr_sqrt": F.sqrt(clipped), "ctr_log1p": F.log1p(clipped)}
