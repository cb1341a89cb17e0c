"""Daily keyword counts and bursts against a recent baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import burst_percent
from ..schema import BASELINE_DAYS, BASELINE_FLOOR, BURST_TOPICS, RISING_THRESHOLD
from .phrases import post_terms


def keyword_counts(
    posts: DataFrame, day: Column, threshold: float = RISING_THRESHOLD, block_substrings: bool = True,
) -> DataFrame:
    """(date, term, cnt): phrase occurrences in rising posts."""
    rising = posts.where(F.col("trend_score") >= threshold).withColumn("date", day)
    return post_terms(rising, "date", block_substrings=block_substrings).groupBy("date", "term").agg(
        F.count("*").alias("cnt")
    )


def burst_topics(
    history: DataFrame, day: Column, baseline_days: int = BASELINE_DAYS,
    top_n: int | None = BURST_TOPICS, floor: float = BASELINE_FLOOR, past_only: bool = False,
) -> DataFrame:
    """(term, today_count, pct_change): terms of `day` against the summed counts of the most
    recent `baseline_days` other dates (also later ones, unless `past_only`).

    The oldest baseline date is a scalar subquery over distinct dates, so both it and `day` prune
    date partitions; one aggregation by term then serves both sides of the comparison.
    """
    others = history.where(F.col("date") < day if past_only else F.col("date") != day)
    recent = others.select("date").distinct().orderBy(F.col("date").desc()).limit(baseline_days)
    oldest = recent.agg(F.min("date")).scalar()
    today = F.col("date") == day
    in_baseline = F.col("date") >= oldest
    rows = history.where(today | in_baseline)
    if past_only:
        rows = rows.where(F.col("date") <= day)
    per_term = rows.groupBy("term").agg(
        F.sum(F.when(today, F.col("cnt"))).alias("today_count"),
        F.sum(F.when(~today, F.col("cnt"))).alias("baseline"),
    ).where("today_count >= 1")
    scored = per_term.select(
        "term", "today_count",
        burst_percent(F.col("today_count"), F.col("baseline"), floor).alias("pct_change"),
    )
    ordered = scored.orderBy(F.round("pct_change", 9).desc(), "term")
    return scored if top_n is None else ordered.limit(top_n)
