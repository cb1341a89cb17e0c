"""Trend score (0-100) of forum and news posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import parse_time
from ..functions.scoring import default_trend, growth_score, min_max, velocity
from ..functions.text import text_or_empty
from .clean import KEY, url_key
from .history import growth_by_url
from .joins import salted_lookup
from .keywords import add_keywords

def interest_scores(series: DataFrame) -> DataFrame:
    """(keyword, interest) from search-interest rows (keyword, ts, value).

    The last value is compared with the 4th from the end, or with the first if there are fewer;
    a single value stands for itself. Rows of an unfinished period may come flagged
    `is_partial`; like any other row they count.
    """
    valued = series.where(F.col("value").isNotNull())
    latest = Window.partitionBy("keyword").orderBy(F.col("ts").desc(), F.col("value").desc())
    tail = valued.withColumn("rn", F.row_number().over(latest)).where("rn <= 4")
    per_keyword = tail.groupBy("keyword").agg(
        F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("last"),
        F.max_by("value", "rn").alias("earlier"),
        F.count("*").alias("n"),
    )
    return per_keyword.select(
        "keyword",
        F.when(F.col("n") == 1, F.col("last"))
        .otherwise(growth_score(F.col("last"), F.col("earlier")))
        .alias("interest"),
    )


def interest_key(keywords: Column) -> Column:
    return F.nullif(F.trim(text_or_empty(keywords)), F.lit(""))


def forum_trend(posts: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Add `forum_trend` to forum posts: history growth where the url has two or more days, else
    velocity scaled over all posts without growth. A post without url gets 50.

    The velocity range is a one-row aggregate over narrow columns, read back as a scalar subquery.
    """
    growth = growth_by_url(history).select(
        url_key(F.col("url")).alias(KEY), "growth_score"
    )
    forum = (F.col("source") == "reddit") & F.col("url").isNotNull()
    raw_velocity = F.when(
        forum & F.col("growth_score").isNull(),
        velocity(F.col("score"), parse_time(F.col("created_at")), as_of),
    )
    joined = posts.join(growth, KEY, "left").withColumn("velocity", raw_velocity)
    span = joined.agg(
        F.struct(F.min("velocity").alias("low"), F.max("velocity").alias("high")).alias("span")
    ).scalar()
    score = (
        F.when(F.col("source") != "reddit", None)
        .when(F.col("url").isNull(), F.lit(50.0))
        .when(F.col("growth_score").isNotNull(), F.col("growth_score"))
        .otherwise(min_max(F.col("velocity"), span["low"], span["high"]))
    )
    return joined.withColumn("forum_trend", score).drop("growth_score", "velocity")


def news_trend(posts: DataFrame, interest: DataFrame) -> DataFrame:
    """(post_key, news_trend) of news posts from (keyword, interest); 50 for unknown keywords.

    Only key and keyword travel through this join, salted because one keyword may be very common.
    """
    asked = posts.where(F.col("source") == "news").select(
        KEY, interest_key(F.col("keywords")).alias("keyword")
    )
    return salted_lookup(asked, interest, "keyword", F.col(KEY)).select(
        KEY, default_trend(F.col("interest")).alias("news_trend")
    )


def score_trends(
    posts: DataFrame, history: DataFrame, as_of: Column, interest: DataFrame | None = None,
    keywords: bool = True,
) -> DataFrame:
    """Add `trend_score` and `keywords` to cleaned posts.

    `history` holds one row per (url, date). `interest` is (keyword, interest) from
    `interest_scores`; without it (trend lookups skipped) news posts score a flat 50.
    With `keywords=False` the batch keeps the keywords it has.
    """
    if keywords:
        posts = add_keywords(posts)
    scored = forum_trend(posts, history, as_of)
    news = F.lit(50.0)
    if interest is not None:
        scored = scored.join(news_trend(posts, interest), KEY, "left")
        news = F.col("news_trend")
    trend = F.when(F.col("source") == "news", news).otherwise(F.col("forum_trend"))
    return scored.withColumn("trend_score", default_trend(trend)).drop("forum_trend", "news_trend")
