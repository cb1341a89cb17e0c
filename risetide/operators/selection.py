"""Top-N selections of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import trend_bucket
from ..schema import DISPLAY_COLUMNS, POSTS_PER_BUCKET, TABLE_ROWS, only_columns
from .clean import landed_order

ALL_CATEGORIES = "All"


def with_bucket(posts: DataFrame) -> DataFrame:
    """Add `bucket`: rising, falling or stable."""
    return posts.withColumn("bucket", trend_bucket(F.col("trend_score")))


def top_per_bucket(
    posts: DataFrame, n: int = POSTS_PER_BUCKET, by_category: bool = True,
) -> DataFrame:
    """The `n` rising (highest trend), falling (lowest trend) and new (latest of the stable) posts
    of each category, with `bucket` and `rank`; ties go to the post seen first.

    The rank filter runs in each map task first, so a category holding a third of all posts sends
    no more than `n` rows per task and bucket.
    """
    narrow = posts.drop("body", "phrases", "entities")   # never sort what a list does not show
    bucketed = with_bucket(narrow).where(F.col("bucket").isNotNull())
    if by_category:
        bucketed = bucketed.where(F.col("category").isNotNull())
    else:
        bucketed = bucketed.withColumn("category", F.lit(ALL_CATEGORIES))
    bucketed = bucketed.withColumn(
        "bucket", F.when(F.col("bucket") == "stable", "new").otherwise(F.col("bucket"))
    )
    by_trend = F.when(F.col("bucket") == "rising", -F.col("trend_score")).when(
        F.col("bucket") == "falling", F.col("trend_score")
    )
    by_time = F.when(F.col("bucket") == "new", F.col("created_at"))
    order = Window.partitionBy("category", "bucket").orderBy(
        by_trend.asc(), by_time.desc_nulls_last(), *_first_seen(posts)
    )
    return bucketed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _first_seen(posts: DataFrame) -> list[Column]:
    return landed_order(posts) + ([F.col("url").asc()] if "url" in posts.columns else [])


def filter_posts(
    posts: DataFrame, category: str | None = None, source: str | None = None,
    sentiment: str | None = None,
) -> DataFrame:
    """Conjunction of the given filters; None or "All" leaves a column unfiltered. Only a batch without
    sentiment may be asked for one: it is then not filtered by it."""
    for column, value in (("category", category), ("source", source), ("sentiment_label", sentiment)):
        if value is None or value == ALL_CATEGORIES:
            continue
        if column in posts.columns:
            posts = posts.where(F.col(column) == value)
        elif column != "sentiment_label":
            raise ValueError(f"the posts have no column {column} to filter by")
    return posts


def sort_posts(posts: DataFrame, sort_by: str = "trend_score") -> DataFrame:
    """Sort by one column, nulls last; ascending only for `created_at`."""
    key = F.col(sort_by)
    order = key.asc_nulls_last() if sort_by == "created_at" else key.desc_nulls_last()
    return posts.orderBy(order, *_first_seen(posts))


def post_table(
    posts: DataFrame, category: str | None = None, source: str | None = None,
    sentiment: str | None = None, sort_by: str = "trend_score", rows: int = TABLE_ROWS,
) -> DataFrame:
    """The filtered, sorted table view: its first `rows` rows, display columns only."""
    chosen = sort_posts(filter_posts(posts, category, source, sentiment), sort_by)
    return only_columns(chosen.limit(rows), DISPLAY_COLUMNS)
