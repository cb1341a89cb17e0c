"""Report aggregates over a day's posts. All combine in the map task before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import (
    DEFAULT_TREND, FALLING_THRESHOLD, RISING_THRESHOLD, ROLLUP_DAYS, SENTIMENT_LABELS,
)

HISTOGRAM_BINS = 20


def _rising() -> Column:
    return F.count_if(F.col("trend_score") >= RISING_THRESHOLD)


def _falling() -> Column:
    return F.count_if(F.col("trend_score") <= FALLING_THRESHOLD)


def ensure_trend(posts: DataFrame) -> DataFrame:
    """Give a batch without trend scores the neutral score."""
    if "trend_score" in posts.columns:
        return posts
    return posts.withColumn("trend_score", F.lit(DEFAULT_TREND))


def kpis(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.count("*").alias("total_posts"), _rising().alias("rising"), _falling().alias("falling"),
        F.avg("trend_score").alias("avg_trend"),
        F.count_if(F.col("source") == "reddit").alias("reddit_posts"),
        F.count_if(F.col("source") == "news").alias("news_posts"),
    )


def trend_histogram(posts: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, posts): equal bins over 0..100; 100 falls into the last one."""
    slot = F.least(
        F.floor(F.col("trend_score") / F.lit(100.0 / bins)), F.lit(bins - 1)
    ).cast("int")
    width = 100.0 / bins
    return posts.where(F.col("trend_score").isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count("*").alias("posts")
    ).select("bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"), "posts")


def sentiment_counts(posts: DataFrame) -> DataFrame:
    """One row for each of the three labels, zero where no post has it."""
    counted = posts.agg(
        *[F.count_if(F.col("sentiment_label") == s).alias(s) for s in SENTIMENT_LABELS]
    )
    return counted.unpivot([], SENTIMENT_LABELS, "sentiment_label", "posts")


def sentiment_by_category(posts: DataFrame) -> DataFrame:
    return posts.where("category is not null and sentiment_label is not null").groupBy(
        "category", "sentiment_label"
    ).agg(F.count("*").alias("posts"))


def share_of_voice(posts: DataFrame) -> DataFrame:
    """Posts per category and source with the share of the category's total in percent."""
    counted = posts.where("category is not null and source is not null").groupBy(
        "category", "source"
    ).agg(F.count("*").alias("posts"))
    total = F.sum("posts").over(Window.partitionBy("category"))
    return counted.withColumn("share_pct", F.bround(F.col("posts") / total * 100, 1))


def daily_rollup(posts: DataFrame, days: int = ROLLUP_DAYS) -> DataFrame:
    """Posts, rising and falling per day for the latest `days` days: one pass over narrow columns, then
    the newest of the few result rows."""
    per_day = posts.where("date is not null").groupBy("date").agg(
        F.count("*").alias("posts"), _rising().alias("rising"), _falling().alias("falling")
    )
    return per_day.orderBy(F.col("date").desc()).limit(days)


def categories(posts: DataFrame) -> DataFrame:
    return posts.select("category").where("category is not null").distinct().orderBy("category")
