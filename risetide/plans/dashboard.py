"""The dashboard's questions over one stored day, as named frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import report
from ..operators.burst import burst_topics
from ..operators.graph import topic_clusters
from ..operators.lexicon import ensure_sentiment
from ..operators.selection import filter_posts, post_table, sort_posts, top_per_bucket
from ..operators.topics import TopicOptions, diversify, emerging_topics
from ..sources.scratch import Scratch
from ..sources.tables import POSTS, Lake, write_csv
from .daily import Inputs, phrase_posts


def day_posts(
    lake: Lake, day: Column | None = None, category: str | None = None, inputs: Inputs = Inputs(),
) -> DataFrame:
    """One day's posts (the newest by default), optionally of one category, with the trend and
    sentiment columns guaranteed."""
    posts = lake.posts()
    if day is None:
        day = F.lit(max(lake.partitions(POSTS, "date"), default=None))
    chosen = filter_posts(posts.where(F.col("date") == day), category=category)
    chosen = report.ensure_trend(chosen)
    if inputs.valence is not None:
        chosen = ensure_sentiment(chosen, inputs.valence)
    return chosen


def overview(posts: DataFrame) -> dict[str, DataFrame]:
    return {
        "kpis": report.kpis(posts),
        "trend_histogram": report.trend_histogram(posts),
        "sentiment_counts": report.sentiment_counts(posts),
        "sentiment_by_category": report.sentiment_by_category(posts),
        "share_of_voice": report.share_of_voice(posts),
        "categories": report.categories(posts),
    }


def topics(
    posts: DataFrame, history: DataFrame, day: Column, inputs: Inputs = Inputs(),
    options: TopicOptions = TopicOptions(),
) -> dict[str, DataFrame]:
    phrased = Scratch(posts.sparkSession).save(
        phrase_posts(posts, inputs).select("category", "source", "trend_score", "phrases", "entities")
    )
    found = emerging_topics(phrased, options)
    overall = found.where(F.col("scope") == "all")
    return {
        "overall": diversify(overall, options.top_n),
        "by_category": found.where(F.col("scope") == "category"),
        "by_source": found.where(F.col("scope") == "source"),
        "burst": burst_topics(history, day),
    }


def clusters(posts: DataFrame, inputs: Inputs = Inputs()) -> DataFrame:
    return topic_clusters(phrase_posts(posts, inputs))


def trend_lists(posts: DataFrame) -> dict[str, DataFrame]:
    return {
        "all": top_per_bucket(posts, by_category=False),
        "by_category": top_per_bucket(posts),
    }


def export(posts: DataFrame, path: str, sort_by: str = "trend_score", **filters: str | None) -> None:
    """Write the whole filtered, sorted set (not only the rows shown) as CSV."""
    write_csv(sort_posts(filter_posts(posts, **filters), sort_by), path)


__all__ = ["day_posts", "overview", "topics", "clusters", "trend_lists", "post_table", "export"]
