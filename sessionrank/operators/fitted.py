"""Statistics fitted on training rows and applied to any rows. Fit gives a frame, apply joins it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.functions.rates import standard_score
from sessionrank.operators.ordering import weighted_quantile


def category_price(train: DataFrame, category: str, price: str) -> DataFrame:
    """Mean and sample standard deviation of the price per category."""
    return train.groupBy(category).agg(F.avg(price).alias("mu"), F.stddev_samp(price).alias("sigma"))


def add_category_z(df: DataFrame, stats: DataFrame, category: str, price: str, out: str = "price_z_cat") -> DataFrame:
    joined = df.join(stats, category, "left")
    return joined.withColumn(out, standard_score(F.col(price), F.col("mu"), F.col("sigma"))).drop("mu", "sigma")


def user_term(train: DataFrame, user: str = "user_id", term: str = "search_term", item: str = "content_id", price: str | None = None) -> DataFrame:
    """Per (user, term): rows, distinct items and mean price."""
    aggs = [F.count(F.lit(1)).alias("user_term_freq"), F.count_distinct(item).alias("user_term_unique_content")]
    if price:
        aggs.append(F.avg(price).alias("user_term_avg_price"))
    return train.groupBy(user, term).agg(*aggs)


def add_user_term(df: DataFrame, stats: DataFrame, median: float | None, user: str = "user_id", term: str = "search_term") -> DataFrame:
    joined = df.join(stats, [user, term], "left").na.fill(0, ["user_term_freq", "user_term_unique_content"])
    return joined if median is None else joined.na.fill({"user_term_avg_price": median})


def user_term_affinity(train: DataFrame, test: DataFrame, user: str = "user_id", term: str = "search_term", price: str = "selling_price"):
    """(train, test) with user-term statistics of the training rows; pairs unseen there get 0 and the train median."""
    for side in (train, test):
        missing = [c for c in (user, term) if c not in side.columns]
        if missing:
            raise KeyError(f"missing columns {missing} for user-term affinity")
    stats = user_term(train, user, term, price=price)
    # every training row carries its pair's mean, so the median weighs pairs by their rows; rows without a key meet no pair
    median = weighted_quantile(stats.dropna(subset=[user, term]), "user_term_avg_price", "user_term_freq", 0.5)
    return add_user_term(train, stats, median, user, term), add_user_term(test, stats, median, user, term)


def user_mean_price(ordered: DataFrame, user: str, price: str) -> DataFrame:
    return ordered.groupBy(user).agg(F.avg(price).alias("user_avg_price"))


def add_user_mean_price(df: DataFrame, means: DataFrame, user: str = "user_id") -> DataFrame:
    """The user's mean price; users without orders get the mean over users."""
    overall = means.select(F.avg("user_avg_price")).scalar()
    return df.join(means, user, "left").withColumn("user_avg_price", F.coalesce("user_avg_price", overall))


def session_price(df: DataFrame, session: str = "session_id", price: str = "selling_price") -> DataFrame:
    """Session mean, sample deviation (0 for one item) and z of the price, plus session size.

    The statistics are an aggregate joined back, so a session with most of the rows is
    pre-aggregated and its rows can be split over tasks.
    """
    stats = df.groupBy(session).agg(
        F.avg(price).alias("sess_price_mean"),
        F.coalesce(F.stddev_samp(price), F.lit(0.0)).alias("sess_price_std"),
        F.count(F.lit(1)).alias("sess_n_items"),
    )
    value = F.coalesce(F.col(price), F.lit(0.0))
    z = standard_score(value, F.col("sess_price_mean"), F.col("sess_price_std"))
    return df.join(stats, session).withColumn("sess_price_z", z)
