"""Parquet and CSV sources: known tables, projected reads, catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The source tables of the ranking data set and where they lie below a data root.
SOURCE_PATHS = {
    "train_sessions": "train_sessions.parquet",
    "test_sessions": "test_sessions.parquet",
    "content_metadata": "content/metadata.parquet",
    "content_price": "content/price_rate_review_data.parquet",
    "content_search_log": "content/search_log.parquet",
    "content_sitewide_log": "content/sitewide_log.parquet",
    "content_top_terms_log": "content/top_terms_log.parquet",
    "user_metadata": "user/metadata.parquet",
    "user_search_log": "user/search_log.parquet",
    "user_sitewide_log": "user/sitewide_log.parquet",
    "user_top_terms_log": "user/top_terms_log.parquet",
    "user_fashion_search_log": "user/fashion_search_log.parquet",
    "user_fashion_sitewide_log": "user/fashion_sitewide_log.parquet",
    "term_search_log": "term/search_log.parquet",
}

_LOG_KEYS = {"content": "content_id_hashed string", "user": "user_id_hashed string", "term": "search_term_normalized string"}
_SEARCH = "total_search_impression double, total_search_click double"
_SITEWIDE = "total_click double, total_cart double, total_fav double, total_order double"

# Column names of the source tables.
SOURCE_SCHEMAS = {
    "train_sessions": "ts_hour timestamp, search_term_normalized string, user_id_hashed string, content_id_hashed string, "
    "session_id string, clicked int, ordered int, added_to_cart int, added_to_fav int",
    "test_sessions": "ts_hour timestamp, search_term_normalized string, user_id_hashed string, content_id_hashed string, session_id string",
    "content_metadata": "content_id_hashed string, level1_category_name string, level2_category_name string, leaf_category_name string, "
    "attribute_type_count double, total_attribute_option_count double, merchant_count double, filterable_label_count double, "
    "content_creation_date timestamp, cv_tags string",
    "content_price": "content_id_hashed string, update_date timestamp, original_price double, selling_price double, discounted_price double, "
    "content_review_count double, content_review_wth_media_count double, content_rate_count double, content_rate_avg double",
    "content_search_log": f"{_LOG_KEYS['content']}, date timestamp, {_SEARCH}",
    "content_sitewide_log": f"{_LOG_KEYS['content']}, date timestamp, {_SITEWIDE}",
    "content_top_terms_log": f"{_LOG_KEYS['content']}, {_LOG_KEYS['term']}, date timestamp, {_SEARCH}",
    "user_metadata": "user_id_hashed string, user_gender string, user_birth_year double, user_tenure_in_days double",
    "user_search_log": f"{_LOG_KEYS['user']}, ts_hour timestamp, {_SEARCH}",
    "user_sitewide_log": f"{_LOG_KEYS['user']}, ts_hour timestamp, {_SITEWIDE}",
    "user_top_terms_log": f"{_LOG_KEYS['user']}, {_LOG_KEYS['term']}, ts_hour timestamp, {_SEARCH}",
    "user_fashion_search_log": f"{_LOG_KEYS['user']}, {_LOG_KEYS['content']}, ts_hour timestamp, {_SEARCH}",
    "user_fashion_sitewide_log": f"{_LOG_KEYS['user']}, {_LOG_KEYS['content']}, ts_hour timestamp, {_SITEWIDE}",
    "term_search_log": f"{_LOG_KEYS['term']}, ts_hour timestamp, {_SEARCH}",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def source(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A known source table with its declared schema."""
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{root}/{SOURCE_PATHS[name]}")


def read_columns(spark: SparkSession, path: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Projected Parquet read; ``limit`` is the dry-run switch."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def read_slice(spark: SparkSession, path: str, columns: Sequence[str], condition) -> DataFrame:
    """Columns of the rows that meet a condition; both reach the Parquet reader."""
    return spark.read.parquet(path).where(condition).select(*columns)


def read_ranked_csv(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """A (session_id, prediction) CSV file with a header."""
    return spark.read.option("header", True).schema(f"session_id {key_type}, prediction string").csv(path)


def load_all(spark: SparkSession, paths: Mapping[str, str], register: bool = False) -> dict[str, DataFrame]:
    """Every table that exists, by name; absent ones are left out."""
    frames = {}
    for name, path in paths.items():
        try:
            frames[name] = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if register:
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
    return frames


# The reader that answers counts from Parquet footers; set on a session of its own, so that the caller's plans stay as they are.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, n_rows, n_columns) of every table that exists, from the footers of its files: no column is read."""
    own = spark.newSession()
    for name, value in FOOTERS.items():
        own.conf.set(name, value)
    return catalog(load_all(own, paths))


def catalog(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns) of the loaded tables."""
    sizes = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, sizes)
