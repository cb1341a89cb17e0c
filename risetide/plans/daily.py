"""The daily run: land raw posts, process a day, refresh when stale."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import as_of_day, as_of_timestamp
from ..operators.burst import keyword_counts
from ..operators.clean import KEY, LANDED, clean_posts, url_key
from ..operators.history import day_scores, merge_history, refetched_scores, retain
from ..operators.lexicon import add_entities, add_sentiment, classify_posts, no_entities
from ..operators.phrases import add_phrases, spread_by_text
from ..operators.tracking import update_tracked
from ..operators.trend import interest_scores, score_trends
from ..schema import (
    DEFAULT_CATEGORY, KEYWORD_RETENTION_DAYS, POST_TYPES, RISING_THRESHOLD, SCORE_RETENTION_DAYS,
)
from ..sources.landing import feed_posts, forum_posts, news_articles, with_fallback
from ..sources.scratch import Scratch
from ..sources.tables import KEYWORDS, POSTS, SCORES, TRACKED, Lake, day_ready, is_stale, land_raw

OK, FAILED = 0, 1


@dataclass(frozen=True)
class Inputs:
    """Side tables of a run. A missing lexicon gives its neutral result for every post: category
    "general", sentiment 0 and neutral, no entities."""

    categories: DataFrame | None = None   # (term, category, weight)
    valence: DataFrame | None = None      # (term, valence)
    gazetteer: DataFrame | None = None    # (entity, type)
    interest: DataFrame | None = None     # (keyword, ts, value); None skips trend lookups
    snapshots: DataFrame | None = None    # (url, date, score) re-fetched scores


def collect_day(
    lake: Lake, as_of: datetime, submissions: DataFrame | None = None,
    articles: DataFrame | None = None, entries: DataFrame | None = None,
) -> int:
    """Land a day's payloads: forum submissions, then news (feed entries only if the articles are
    empty). A source that is given replaces what it landed before, also with nothing. Fails only when
    none of the given sources has a row."""
    now = as_of_timestamp(as_of)
    batches, sources = [], []
    if submissions is not None:
        batches.append(forum_posts(submissions))
        sources.append("reddit")
    news = [
        mapped for mapped in (
            None if articles is None else news_articles(articles, now),
            None if entries is None else feed_posts(entries, now),
        ) if mapped is not None
    ]
    if news:
        batches.append(news[0] if len(news) == 1 else with_fallback(*news))
        sources.append("news")
    if not batches:
        return FAILED
    land_raw(lake, batches, as_of, sources)
    landed = lake.raw().where(F.col("source").isin(sources) & (F.col("batch") == 0))
    return OK if day_ready(landed, as_of_day(as_of), require_all=False) else FAILED


def enrich(
    raw: DataFrame, history: DataFrame, inputs: Inputs, as_of: datetime,
) -> DataFrame:
    """Raw rows to enriched posts in one lazy plan."""
    return enrich_cleaned(clean_posts(raw), history, inputs, as_of)


def enrich_cleaned(
    posts: DataFrame, history: DataFrame, inputs: Inputs, as_of: datetime,
) -> DataFrame:
    """Cleaned to enriched posts. The posts are shuffled once, by url key; the history and interest joins
    bring narrow rows to that partitioning."""
    if inputs.categories is not None:
        posts = classify_posts(posts, inputs.categories)
    else:
        posts = posts.withColumn("category", F.lit(DEFAULT_CATEGORY))
    if inputs.gazetteer is not None:
        posts = add_entities(posts, inputs.gazetteer)
    interest = None if inputs.interest is None else interest_scores(inputs.interest)
    posts = score_trends(posts, history, as_of_timestamp(as_of), interest)
    if inputs.valence is not None:
        return add_sentiment(posts, inputs.valence)
    return posts.withColumn("sentiment_score", F.lit(0.0)).withColumn(
        "sentiment_label", F.lit("neutral")
    )


def process_day(
    lake: Lake, as_of: datetime, inputs: Inputs = Inputs(),
    require_all: bool = False,
) -> int:
    """Process one landed day and update all day-keyed state. Running it again for the same day
    rewrites the same partitions: nothing is counted twice."""
    day = as_of_day(as_of)
    raw = lake.raw().where(F.col("date") == day)
    if not day_ready(lake.raw(), day, require_all):
        return FAILED

    today_utc = (as_of if as_of.tzinfo is None else as_of.astimezone(timezone.utc)).date()
    lake.begin(today_utc)
    tracked = lake.tracked_before(day)
    refetched = lake.scores().limit(0)
    if inputs.snapshots is not None:
        refetched = refetched_scores(tracked, inputs.snapshots).where(F.col("date") == day)
    stored = lake.scores().where(F.col("date") < day)
    history = merge_history(stored, day, SCORE_RETENTION_DAYS, refetched=refetched)

    # categories, trend and sentiment each read the posts: they are cleaned once
    scratch = Scratch(lake.spark, lake.path("scratch"))
    cleaned = scratch.save(clean_posts(raw))
    try:
        posts = enrich_cleaned(cleaned, history, inputs, as_of)
        lake.write(
            posts.select(*POST_TYPES, *LANDED, day.alias("date")), POSTS, "date"
        )
    finally:
        scratch.forget(cleaned)
    # Everything below starts from the written partition, not from the plan above.
    today = lake.posts().where(F.col("date") == day)

    lake.write(
        merge_history(refetched, day, SCORE_RETENTION_DAYS, scored=day_scores(today, day)),
        SCORES, "date",
    )
    rising = today.where(F.col("trend_score") >= RISING_THRESHOLD)
    lake.write(keyword_counts(phrase_posts(rising, inputs), day), KEYWORDS, "date")
    window = retain(lake.scores(), day, SCORE_RETENTION_DAYS)
    updated = update_tracked(tracked, today, window, day)
    lake.write(updated.withColumn("version", day), TRACKED, "version")

    lake.drop_before(SCORES, "date", today_utc - timedelta(days=SCORE_RETENTION_DAYS))
    lake.drop_before(KEYWORDS, "date", today_utc - timedelta(days=KEYWORD_RETENTION_DAYS))
    # a rerun of this day needs the newest version before it, however old
    older = [v for v in lake.partitions(TRACKED, "version") if v < today_utc]
    if older:
        lake.drop_before(TRACKED, "version", min(max(older), today_utc - timedelta(days=KEYWORD_RETENTION_DAYS)))
    lake.commit()
    return OK


def phrase_posts(posts: DataFrame, inputs: Inputs = Inputs()) -> DataFrame:
    """Posts of a stored day with `phrases` and `entities`, dealt over tasks by their text."""
    narrow = posts.select(
        url_key(F.col("url")).alias(KEY), "title", "body", "keywords", "category", "source",
        "trend_score",
    )
    if inputs.gazetteer is not None:
        narrow = add_entities(narrow, inputs.gazetteer)
    else:
        narrow = no_entities(narrow)
    return add_phrases(spread_by_text(narrow, posts))


def refresh_day(
    lake: Lake, as_of: datetime, inputs: Inputs = Inputs(),
    require_all: bool = True,
) -> bool:
    """Make the day's posts current: False when raw rows are missing, nothing to do when the posts
    are newer than the raw rows, else process."""
    day = as_of_day(as_of)
    if not day_ready(lake.raw(), day, require_all):
        return False
    if not is_stale(lake.raw(), lake.posts(), day):
        return True
    return process_day(lake, as_of, inputs) == OK
