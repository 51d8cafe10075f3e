"""Flags for how well a user and an item go together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The gender, categories and category words of the original flags.
WOMAN = "Bayan"
FASHION_CATEGORIES = ["Giyim", "Ayakkabı", "Aksesuar"]
YOUNG_WORDS = "Genç|Casual"
MATURE_WORDS = "Klasik|Şık"


def gender_category(gender: Column, category: Column, wanted: str = WOMAN, categories: Sequence[str] = FASHION_CATEGORIES) -> Column:
    return (gender == wanted) & category.isin(*categories)


def age_category(age: Column, category: Column, young: str = YOUNG_WORDS, mature: str = MATURE_WORDS) -> Column:
    """Up to 30 with a young category, or from 40 with a mature one; unknown is no match."""
    return F.coalesce((age <= 30) & category.rlike(young), F.lit(False)) | F.coalesce((age >= 40) & category.rlike(mature), F.lit(False))


def price_tolerance(price: Column, past_orders: Column) -> Column:
    """Users with ten past orders or more accept up to 500, others up to 200."""
    return F.when(past_orders >= 10, price <= 500).otherwise(price <= 200)
