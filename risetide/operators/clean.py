"""Cleaning a raw post batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import lenient_bigint, time_text
from ..functions.text import strip_markup
from ..schema import VALID_SOURCES, conform

KEY = "post_key"
# first-seen order: landing order of the batches, micro-batch, place in the batch
LANDED = ("landing_rank", "batch", "seq", "pos")


def url_key(url: Column) -> Column:
    """A key that is never null: one value per distinct url, one more for all null urls."""
    return F.coalesce(F.concat(F.lit("="), url), F.lit(""))


def union_sources(*batches: DataFrame) -> DataFrame:
    """Union raw batches in landing order; earlier batches win the url dedup."""
    ranked = []
    for rank, batch in enumerate(batches):
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.monotonically_increasing_id())
        ranked.append(batch.withColumn("landing_rank", F.lit(rank)))
    out = ranked[0]
    for other in ranked[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and map task before the shuffle,
    so a key that holds a third of the rows costs no more than any other."""
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def landed_order(posts: DataFrame) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in LANDED if c in posts.columns]


def clean_posts(raw: DataFrame) -> DataFrame:
    """Dedup by url (first in landing order), then clean texts, coerce types and drop rows of
    unknown source. Dedup comes first: a row of unknown source hides later rows of its url.

    The result keeps the `LANDED` columns (first-seen order) and `post_key` (non-null url
    key); it is hash-partitioned by `post_key`, which later per-post joins reuse.
    """
    if "landing_rank" not in raw.columns:
        raw = union_sources(raw)
    raw = conform(raw)
    unique = first_per_key(
        raw.withColumn(KEY, url_key(F.col("url"))), KEY, *landed_order(raw)
    )
    return unique.where(F.coalesce(F.col("source").isin(VALID_SOURCES), F.lit(False))).withColumns(
        {
            "title": strip_markup(F.col("title")),
            "body": strip_markup(F.col("body")),
            "score": lenient_bigint(F.col("score")),
            "created_at": time_text(F.col("created_at")),
        }
    )
