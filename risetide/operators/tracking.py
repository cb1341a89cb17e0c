"""Registry of tracked posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import LOSING_DAYS_REMOVE, POSTS_PER_BUCKET, STALE_DAYS_REMOVE
from .clean import LANDED
from .history import score_runs
from .selection import top_per_bucket


def curated_posts(posts: DataFrame, n: int = POSTS_PER_BUCKET) -> DataFrame:
    """(url, category, source) of the forum posts among the top-N lists of every category. The
    source filter comes after the cut: news posts use up places."""
    return top_per_bucket(
        posts.select(
            "url", "category", "source", "trend_score", "created_at",
            *[c for c in LANDED if c in posts.columns],
        ), n,
    ).where((F.col("source") == "reddit") & (F.col("url") != "")).select("url", "category", "source")


def add_tracked(tracked: DataFrame, curated: DataFrame, day: Column) -> DataFrame:
    """Insert curated urls that are not tracked yet; existing rows keep their metadata."""
    new = curated.join(tracked.select("url"), "url", "left_anti").withColumn("added_date", day)
    return tracked.select("url", "category", "source", "added_date").unionByName(
        new.select("url", "category", "source", "added_date")
    )


def prune_tracked(
    tracked: DataFrame, history: DataFrame, losing: int = LOSING_DAYS_REMOVE,
    stale: int = STALE_DAYS_REMOVE,
) -> DataFrame:
    """Drop urls losing for `losing` or stale for `stale` days; urls without history stay."""
    gone = score_runs(history).where(
        (F.col("days_losing") >= losing) | (F.col("days_stale") >= stale)
    )
    return tracked.join(gone.select("url"), "url", "left_anti")


def update_tracked(
    tracked: DataFrame, posts: DataFrame, history: DataFrame, day: Column,
    n: int = POSTS_PER_BUCKET,
) -> DataFrame:
    """Add the day's curated posts, then prune."""
    return prune_tracked(add_tracked(tracked, curated_posts(posts, n), day), history)
