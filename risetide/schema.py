"""Table schemas, closed domains and default parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values -----------------------------------------------------------------
VALID_SOURCES = ["reddit", "news"]
VALID_CATEGORIES = [
    "tech", "politics", "sports", "business", "entertainment",
    "science", "environment", "health", "general",
]
NEWS_CATEGORIES = [
    "business", "entertainment", "general", "health", "science", "sports", "technology",
]
SENTIMENT_LABELS = ["positive", "negative", "neutral"]
DEFAULT_CATEGORY = "general"
ENTITY_TYPES = ["PERSON", "ORG", "GPE", "EVENT", "PRODUCT"]

RISING_THRESHOLD = 70.0
FALLING_THRESHOLD = 30.0
DEFAULT_TREND = 50.0
SENTIMENT_CUTOFF = 0.02
POSTS_PER_BUCKET = 50
TOPICS_OVERALL = 20
TOPICS_PER_CATEGORY = 20
TOPICS_PER_SOURCE = 8
BURST_TOPICS = 10
CLUSTERS = 5
WORDS_PER_CLUSTER = 10
ENTITY_BOOST = 2.0
MMR_LAMBDA = 0.7
BASELINE_DAYS = 7
BASELINE_FLOOR = 0.5
SCORE_RETENTION_DAYS = 30
KEYWORD_RETENTION_DAYS = 14
LOSING_DAYS_REMOVE = 3
STALE_DAYS_REMOVE = 5
TABLE_ROWS = 100
ROLLUP_DAYS = 14
FEED_ENTRIES = 50

POST_COLUMNS = [
    "id", "source", "title", "url", "created_at", "score", "subreddit", "author", "body",
]
DISPLAY_COLUMNS = [
    "title", "source", "category", "trend_score", "sentiment_label", "score", "keywords",
]

POST_TYPES = {
    "id": "string", "source": "string", "title": "string", "url": "string",
    "created_at": "string", "score": "bigint", "subreddit": "string", "author": "string",
    "body": "string", "category": "string", "trend_score": "double", "keywords": "string",
    "sentiment_score": "double", "sentiment_label": "string",
}
REQUIRED_COLUMNS = ["id", "source", "title", "url", "created_at"]
# ----------------------------------------------------------------------------------

OPTIONAL_COLUMNS = [c for c in POST_TYPES if c not in REQUIRED_COLUMNS]

# Schemas are DDL strings, as `spark.read.schema` and `createDataFrame` take them.
RAW_SCHEMA = ", ".join(f"{c} string" for c in POST_COLUMNS)
POSTS_SCHEMA = (
    ", ".join(f"{name} {kind}" for name, kind in POST_TYPES.items())
    + ", landing_rank int, batch int, seq bigint, pos bigint, date date"
)
SCORES_SCHEMA = "url string, date date, score bigint"
KEYWORDS_SCHEMA = "date date, term string, cnt bigint"
TRACKED_SCHEMA = "url string, category string, source string, added_date date"
SUBMISSION_SCHEMA = (
    "permalink string, created_utc double, selftext string, title string, score bigint, "
    "subreddit string, author string"
)
ARTICLES_SCHEMA = (
    "category string, articles array<struct<url: string, publishedAt: string, title: string, "
    "author: string, description: string>>"
)
RSS_SCHEMA = (
    "feed string, pos int, link string, published string, updated string, summary string, "
    "description string, title string, author string, source struct<title: string>"
)


def conform(df: DataFrame) -> DataFrame:
    """Give a post batch every column of the post schema: "" for missing required columns, 0 for
    a missing score and typed nulls (never "") for the other missing columns."""
    have = set(df.columns)
    missing = {}
    for name, kind in POST_TYPES.items():
        if name in have:
            continue
        if name in REQUIRED_COLUMNS:
            missing[name] = F.lit("")
        elif name == "score":
            missing[name] = F.lit(0).cast("bigint")
        else:
            missing[name] = F.lit(None).cast(kind)
    return df.withColumns(missing) if missing else df


def only_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Project to those of `names` that the frame has, in the given order."""
    return df.select(*[c for c in names if c in df.columns])
