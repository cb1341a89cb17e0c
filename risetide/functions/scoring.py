"""Score arithmetic: growth, velocity, damping, burst and label rules."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, functions as F

from ..schema import (
    DEFAULT_TREND, ENTITY_BOOST, FALLING_THRESHOLD, RISING_THRESHOLD, SENTIMENT_CUTOFF,
)


def as_of_timestamp(as_of: str | datetime) -> Column:
    """The explicit "now" of a run; naive values are UTC."""
    if isinstance(as_of, datetime):
        when = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        return F.timestamp_micros(F.lit(int(when.timestamp() * 1_000_000)))
    return F.to_timestamp(F.lit(as_of))


def as_of_day(as_of: str | date | datetime) -> Column:
    if isinstance(as_of, datetime):
        return F.to_date(as_of_timestamp(as_of))
    return F.to_date(F.lit(str(as_of)[:10]))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def growth_score(latest: Column, previous: Column) -> Column:
    """50 + 25 x relative change limited to one either way; a zero previous value is no change."""
    change = F.when(previous == 0, F.lit(0.0)).otherwise(
        (latest - previous).cast("double") / F.greatest(previous.cast("double"), F.lit(1.0))
    )
    return clamp(F.lit(50.0) + F.lit(25.0) * clamp(change, -1.0, 1.0), 0.0, 100.0)


def age_hours(created: Column, as_of: Column) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(3.6e9)
    return F.greatest(hours, F.lit(0.5))


def velocity(score: Column, created: Column, as_of: Column) -> Column:
    """Score per hour of age; a post of unreadable age counts as 50."""
    return F.when(created.isNull(), F.lit(50.0)).otherwise(
        F.coalesce(score, F.lit(0)).cast("double") / age_hours(created, as_of)
    )


def min_max(value: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(50.0)).otherwise((value - low) / (high - low) * 100)


def trend_bucket(trend: Column) -> Column:
    return (
        F.when(trend >= RISING_THRESHOLD, "rising")
        .when(trend <= FALLING_THRESHOLD, "falling")
        .when(trend.isNotNull(), "stable")
    )


def default_trend(trend: Column) -> Column:
    return F.coalesce(trend, F.lit(DEFAULT_TREND))


def sentiment_label(compound: Column) -> Column:
    return (
        F.when(compound >= SENTIMENT_CUTOFF, "positive")
        .when(compound <= -SENTIMENT_CUTOFF, "negative")
        .otherwise("neutral")
    )


def rising_weight(trend: Column, threshold: float) -> Column:
    return F.greatest(F.lit(0.5), (trend - F.lit(threshold)) / F.lit(30.0))


def topic_score(
    rise: Column, everywhere: Column, n_rising: Column, is_entity: Column,
    damping: bool = True, boost: float = ENTITY_BOOST,
) -> Column:
    """Rising weight, damped by how common the term is over all posts, boosted for entities."""
    score = rise
    if damping:
        score = rise / (F.lit(1.0) + everywhere / F.greatest(n_rising, F.lit(1)))
    return F.when(is_entity, score * F.lit(float(boost))).otherwise(score)


def burst_percent(today: Column, baseline: Column, floor: float) -> Column:
    base = F.coalesce(baseline, F.lit(0)) + F.lit(float(floor))
    return F.when(base > 0, (today - base) / base * 100).otherwise(F.lit(100.0))
