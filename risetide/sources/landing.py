"""Landed source payloads mapped to raw posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import epoch_text, feed_time, published_text, stable_id
from ..functions.text import strip_tags, text_or_empty
from ..operators.clean import first_per_key
from ..schema import FEED_ENTRIES, NEWS_CATEGORIES, POST_COLUMNS

# --- fixed values ---
FORUM_HOST = "https://www.reddit.com"
# --------------------


def _filled(c: Column) -> Column:
    """Null for missing and for empty text."""
    return F.nullif(c, F.lit(""))


def _position(df: DataFrame) -> DataFrame:
    return df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id())


def forum_posts(submissions: DataFrame) -> DataFrame:
    """Landed forum submissions as posts, first row per url. `seq` (listing order) is kept."""
    url = F.concat(F.lit(FORUM_HOST), F.col("permalink"))
    mapped = _position(submissions).select(
        stable_id("reddit", url).alias("id"),
        F.lit("reddit").alias("source"),
        text_or_empty(F.col("title")).alias("title"),
        url.alias("url"),
        epoch_text(F.col("created_utc")).alias("created_at"),
        "score", "subreddit",
        text_or_empty(F.col("author")).alias("author"),
        text_or_empty(F.col("selftext")).alias("body"),
        "seq",
    )
    return first_per_key(mapped, "url", F.col("seq"))


def news_articles(responses: DataFrame, as_of: Column) -> DataFrame:
    """Landed news responses (category, articles) as posts: known categories only, a url required,
    first row per url in (response, position) order, kept as `seq` and `pos`."""
    responses = _position(responses)
    if "category" in responses.columns:
        responses = responses.where(F.col("category").isin(NEWS_CATEGORIES))
    rows = responses.select(F.col("seq").alias("response"), F.posexplode("articles").alias("pos", "a"))
    mapped = rows.where(_filled(F.col("a.url")).isNotNull()).select(
        "response", "pos",
        *_news_columns(
            F.col("a.url"), F.col("a.title"), published_text(F.col("a.publishedAt"), as_of),
            F.col("a.author"), F.col("a.description"),
        ),
    )
    first = first_per_key(mapped, "url", F.col("response"), F.col("pos"))
    return first.select(*POST_COLUMNS, F.col("response").alias("seq"), F.col("pos").cast("bigint").alias("pos"))


def _news_columns(url, title, created_at, author, body) -> list[Column]:
    return [
        stable_id("news", url).alias("id"),
        F.lit("news").alias("source"),
        text_or_empty(title).alias("title"),
        url.alias("url"),
        created_at.alias("created_at"),
        F.lit(0).cast("bigint").alias("score"),
        F.lit("").alias("subreddit"),
        text_or_empty(author).alias("author"),
        text_or_empty(body).alias("body"),
    ]


def feed_posts(entries: DataFrame, as_of: Column, per_feed: int | None = FEED_ENTRIES) -> DataFrame:
    """Landed feed entries as posts: the first `per_feed` entries of each feed, those with a link,
    first row per url in (feed, position) order.

    The feed cut runs in each map task first, so one feed holding most entries is no hot spot.
    """
    if per_feed is not None:
        order = Window.partitionBy("feed").orderBy("pos")
        entries = entries.withColumn("_rn", F.row_number().over(order)).where(
            F.col("_rn") <= per_feed
        )
    have = set(entries.columns)

    def field(name: str) -> Column:
        return _filled(F.col(name)) if name in have else F.lit(None).cast("string")

    source_title = F.col("source.title") if "source" in have else F.lit(None).cast("string")
    mapped = entries.where(_filled(F.col("link")).isNotNull()).select(
        F.col("feed").cast("string").alias("feed"), "pos",
        *_news_columns(
            F.col("link"), field("title"),
            F.coalesce(
                feed_time(field("published")), feed_time(field("updated")),
                F.date_format(as_of, "yyyy-MM-dd HH:mm:ss"),
            ),
            F.coalesce(field("author"), source_title),
            strip_tags(text_or_empty(F.coalesce(field("summary"), field("description")))),
        ),
    )
    first = first_per_key(mapped, "url", F.col("feed"), F.col("pos"))
    return first.select(*POST_COLUMNS, F.col("pos").cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("pos"))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """`primary`, or `fallback` when `primary` has no row at all."""
    return primary.unionByName(fallback.where(~primary.exists()))
