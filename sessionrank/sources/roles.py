"""The source tables under the short column names the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrank.functions.dates import floor_hour
from sessionrank.sources.tables import source

# Short names of the source columns.
SHORT = {
    "content_id_hashed": "content_id",
    "user_id_hashed": "user_id",
    "search_term_normalized": "search_term",
    "leaf_category_name": "leaf_category",
    "level1_category_name": "level1_category",
    "level2_category_name": "level2_category",
    "content_creation_date": "creation_date",
    "content_review_count": "review_count",
    "content_review_wth_media_count": "media_review_count",
    "content_rate_count": "rate_count",
    "content_rate_avg": "rate_avg",
    "total_click": "click",
    "total_cart": "cart",
    "total_fav": "fav",
    "total_order": "orders",
    "total_search_impression": "impression",
    "total_search_click": "click",
    "user_gender": "gender",
    "user_birth_year": "birth_year",
    "user_tenure_in_days": "tenure_days",
}


def role(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A source table with short names; times lose their zone, session times their minutes."""
    df = source(spark, root, name).withColumnsRenamed(SHORT)
    df = df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)})
    if name.endswith("_sessions"):
        df = df.withColumns({"ts_hour": floor_hour("ts_hour")})
    return df


def roles(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: role(spark, root, n) for n in names}
