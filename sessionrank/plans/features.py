"""The whole feature table, from source roles to model input, for training and test sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.functions import dates, rates, text
from sessionrank.operators import aggregates, clean, fitted, relevance, splits
from sessionrank.operators.enrich import enrich
from sessionrank.operators.history import Latest, Running, as_of
from sessionrank.session import durable

SITE = {c: c for c in ("click", "cart", "fav", "orders")}
SEARCH = {c: c for c in ("impression", "click")}
STATIC = ["leaf_category", "attribute_type_count", "total_attribute_option_count", "merchant_count", "filterable_label_count"]
PRICES = ["selling_price", "review_count", "rate_count", "rate_avg"]

# Source roles the table is built from.
ROLES = [
    "content_metadata", "content_price", "content_sitewide_log", "content_search_log", "content_top_terms_log",
    "user_metadata", "user_sitewide_log", "user_search_log", "term_search_log", "user_fashion_sitewide_log",
]


def _enriched(rows: DataFrame, roles: Mapping[str, DataFrame]) -> DataFrame:
    """Static attributes, newest prices and running totals up to each row's hour."""
    content = clean.first_per_key(roles["content_metadata"].select("content_id", *STATIC), ["content_id"], STATIC)
    users = clean.first_per_key(roles["user_metadata"].select("user_id", "gender", "birth_year", "tenure_days"), ["user_id"], ["gender"])
    logs = {
        "content_sw": (roles["content_sitewide_log"], ["content_id"], "date", SITE),
        "content_search": (roles["content_search_log"], ["content_id"], "date", SEARCH),
        "term_content": (roles["content_top_terms_log"], ["content_id", "search_term"], "date", SEARCH),
        "user_sw": (roles["user_sitewide_log"], ["user_id"], "ts_hour", SITE),
        "user_search": (roles["user_search_log"], ["user_id"], "ts_hour", SEARCH),
        "term_search": (roles["term_search_log"], ["search_term"], "ts_hour", SEARCH),
    }
    return enrich(rows, content, users, Latest(roles["content_price"], PRICES, "update_date"), logs)


def _aged(rows: DataFrame, roles: Mapping[str, DataFrame], present) -> DataFrame:
    """Item age, discount of the newest price and user age, seen from the newest session hour."""
    items = roles["content_metadata"].groupBy("content_id").agg(F.min("creation_date").alias("_made"))
    newest = aggregates.latest(roles["content_price"], ["content_id"], ["update_date", "selling_price", "original_price"], ["selling_price", "original_price"])
    discount = newest.select("content_id", rates.discount_pct(F.col("original_price"), F.col("selling_price")).alias("discount_percentage"))
    aged = rows.join(items, "content_id", "left").join(discount, "content_id", "left")
    born = F.when(F.col("birth_year") > 0, F.col("birth_year"))
    return aged.withColumns({
        "product_age_days": F.coalesce(dates.whole_days_between(F.col("_made"), present), F.lit(0)),
        "discount_percentage": F.coalesce("discount_percentage", F.lit(0.0)),
        "user_age": dates.age_from_birth_year(F.year(present), born),
    }).drop("_made")


def _relevant(rows: DataFrame, roles: Mapping[str, DataFrame]) -> DataFrame:
    """Lexical relevance of the search term, squashed to 0..1, and token overlap with the tags."""
    described = text.product_text(F.col("leaf_category"), F.col("cv_tags"), fallback=F.col("content_id"))
    documents = roles["content_metadata"].select("content_id", "cv_tags", described.alias("product_text"))
    documents = clean.first_per_key(documents, ["content_id"], ["product_text"])
    scored = relevance.bm25(rows, documents, out="relevance").join(documents.select("content_id", "cv_tags"), "content_id", "left")
    a, b = text.tokens_by_blank(F.col("search_term")), text.tokens_by_blank(F.col("cv_tags"))
    return scored.withColumns({"relevance": rates.sigmoid(F.col("relevance")), "tag_jaccard": text.jaccard(a, b), "tag_match": text.any_shared(a, b)}).drop("cv_tags")


def feature_tables(train: DataFrame, test: DataFrame, roles: Mapping[str, DataFrame], val_frac: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(train, test) with all features. Statistics are fitted on training rows only:

    category prices on the rows before the validation part, user-term affinity on all.
    """
    keys = ["session_id", "ts_hour", "search_term", "user_id", "content_id"]
    both = train.select("ts_hour").unionByName(test.select("ts_hour"))
    present = both.select(F.max("ts_hour")).scalar()
    # written once: the split, every fitted statistic and both outputs read it
    rows = {
        "train": durable(_enriched(clean.project(train, keys, ["clicked", "ordered"]), roles)),
        "test": durable(_enriched(clean.project(test, keys), roles)),
    }
    rows["train"], rows["test"] = fitted.user_term_affinity(rows["train"], rows["test"])
    early, _ = splits.time_split(rows["train"], val_frac)
    stats = fitted.category_price(early, "leaf_category", "selling_price")
    clicks = Running(roles["user_fashion_sitewide_log"], {"user_content_past_click_count": F.when(F.col("click") > 0, 1).otherwise(0)})
    out = {}
    for name, df in rows.items():
        base = train if name == "train" else test
        df = fitted.add_category_z(df, stats, "leaf_category", "selling_price")
        df = fitted.session_price(df)
        df = as_of(df, ["user_id", "content_id"], [clicks], asked=base).na.fill(0, ["user_content_past_click_count"])
        out[name] = _relevant(_aged(df, roles, present), roles)
    return out["train"], out["test"]
