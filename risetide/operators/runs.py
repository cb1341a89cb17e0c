"""Losing and stale runs from summaries that merge, so that a day adds one row a url.

A summary stands for a url's scores over a stretch of days: its first and last score, and the run that the
walk from the newest day would end in, which is the first run of equal steps after the last rise. Two
stretches that follow each other merge without their scores; merging is associative, so days may be
summarised and merged in any grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEADY = 0.01       # fixed value: a smaller relative rise is no rise
LOSING, STALE = "losing", "stale"
SUMMARY = "first_date date, first_score bigint, last_date date, last_score bigint, grew boolean, step string, days bigint, closed boolean"
_FIELDS = [part.split(" ")[0] for part in SUMMARY.split(", ")]


def step_between(older: Column, newer: Column) -> Column:
    """losing, stale or growth, from one day's score to the next one's."""
    change = F.abs(newer - older) / F.greatest(older.cast("double"), F.lit(1.0))
    return F.when(newer < older, LOSING).when((newer == older) | (change < STEADY), STALE).otherwise("growth")


def one_day(history: DataFrame) -> DataFrame:
    """The summaries of single days: (url, summary) for each row of history (url, date, score)."""
    score = F.col("score").cast("bigint")
    return history.select("url", F.struct(
        F.col("date").alias("first_date"), score.alias("first_score"), F.col("date").alias("last_date"), score.alias("last_score"),
        F.lit(False).alias("grew"), F.lit(None).cast("string").alias("step"), F.lit(0).cast("bigint").alias("days"),
        F.lit(False).alias("closed")).alias("summary"))


def followed_by(a: Column, b: Column) -> Column:
    """The summary of a stretch and the stretch after it."""
    step = step_between(a["last_score"], b["first_score"])
    # the run of the older stretch goes on if it reaches its end
    begins = ~a["closed"] & a["step"].isNull()
    joins = begins | (~a["closed"] & (a["step"] == step))
    # and through the newer one if all of that is in the same step
    through = joins & (b["step"].isNull() | (b["step"] == step))
    fresh = b["grew"] | (step == "growth")
    days = a["days"] + F.when(joins, 1 + F.when(through, b["days"]).otherwise(0)).otherwise(0)
    return F.struct(
        a["first_date"].alias("first_date"), a["first_score"].alias("first_score"),
        b["last_date"].alias("last_date"), b["last_score"].alias("last_score"),
        (a["grew"] | fresh).alias("grew"),
        F.when(fresh, b["step"]).when(begins, step).otherwise(a["step"]).alias("step"),
        F.when(fresh, b["days"]).otherwise(days).cast("bigint").alias("days"),
        F.when(fresh, b["closed"]).otherwise(F.when(through, b["closed"]).otherwise(F.lit(True))).alias("closed"))


def merged(*parts: DataFrame) -> DataFrame:
    """(url, summary), one for each url, of parts (url, summary) that don't overlap in a url's days. A url
    has as many summaries as there are parts, so what meets is bounded by them."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ordered = rows.groupBy("url").agg(F.array_sort(F.collect_list("summary")).alias("own"))
    rest = F.slice("own", F.lit(2), F.greatest(F.size("own") - 1, F.lit(0)))
    summary = F.aggregate(rest, F.get("own", F.lit(0)), lambda a, b: followed_by(a, b))
    return ordered.select("url", summary.cast(f"struct<{', '.join(p.replace(' ', ':') for p in SUMMARY.split(', '))}>").alias("summary"))


def days_of(summaries: DataFrame) -> DataFrame:
    """(url, days_losing, days_stale): what score_runs() tells of the summarised history."""
    days = {s: F.when(F.col("summary.step") == s, F.col("summary.days")).otherwise(F.lit(0)).cast("bigint") for s in (LOSING, STALE)}
    return summaries.select("url", days[LOSING].alias("days_losing"), days[STALE].alias("days_stale"))
