"""Keyword string of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_words, longest_words, lower_words, ngrams, text_or_empty
from ..vocab import KEYWORD_STOPWORDS

# --- fixed values ---
KEYWORD_TERMS = 3
KEYWORD_CHARS = 80
FALLBACK_CHARS = 50
# --------------------


def simple_keywords(title: Column, body: Column) -> Column:
    """The three longest content words of the title (of the body if there is no title); the first
    50 characters of that text when no word qualifies."""
    title, body = text_or_empty(title), text_or_empty(body)
    text = F.when(title != "", title).otherwise(F.trim(body))
    chosen = longest_words(text, KEYWORD_TERMS)
    return F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(
        F.substring(text, 1, FALLBACK_CHARS)
    )


def phrase_keywords(title: Column, body: Column, entities: Column) -> Column:
    """Entities first, then 2-4-word title phrases, the first three joined and cut at 80
    characters; `simple_keywords` when there are neither."""
    phrases = ngrams(content_words(lower_words(title), 3, KEYWORD_STOPWORDS), 2, 4)
    terms = F.slice(F.array_distinct(F.concat(entities, phrases)), 1, KEYWORD_TERMS)
    joined = F.trim(F.substring(F.array_join(terms, " "), 1, KEYWORD_CHARS))
    return F.when(F.size(terms) > 0, joined).otherwise(simple_keywords(title, body))


def add_keywords(posts: DataFrame) -> DataFrame:
    """Set `keywords`; uses `entities` where the batch has that column."""
    title, body = F.col("title"), F.col("body")
    if "entities" in posts.columns:
        return posts.withColumn("keywords", phrase_keywords(title, body, F.col("entities")))
    return posts.withColumn("keywords", simple_keywords(title, body))
