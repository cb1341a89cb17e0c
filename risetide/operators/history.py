"""Score history: one row per (url, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import submission_id
from ..functions.scoring import growth_score

# Later writers win within one (url, date): stored < re-fetched < scored today.
STORED, REFETCHED, SCORED = 0, 1, 2


def retain(df: DataFrame, as_of_day: Column, days: int) -> DataFrame:
    """Rows of the last `days` days; on a date-partitioned table this prunes partitions."""
    return df.where(F.col("date") >= F.date_sub(as_of_day, days))


def unique_scores(history: DataFrame) -> DataFrame:
    """One row per (url, date): the highest score."""
    return history.groupBy("url", "date").agg(F.max("score").alias("score"))


def day_scores(posts: DataFrame, as_of_day: Column) -> DataFrame:
    """History rows of a scored batch: url present, missing score as 0."""
    return posts.where(F.col("url").isNotNull() & (F.col("url") != "")).select(
        "url", as_of_day.alias("date"), F.coalesce("score", F.lit(0)).cast("bigint").alias("score")
    )


def refetched_scores(tracked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Score snapshots of the tracked forum urls, matched on the submission id."""
    wanted = tracked.where(
        (F.col("source") == "reddit") & F.col("url").contains("reddit.com")
    ).select("url", submission_id(F.col("url")).alias("sid")).where("sid is not null")
    seen = snapshots.where(F.col("url").contains("reddit.com")).select(
        submission_id(F.col("url")).alias("sid"), "date", "score"
    ).where("sid is not null").groupBy("sid", "date").agg(F.max("score").alias("score"))
    return wanted.join(seen, "sid").select("url", "date", "score")


def merge_history(
    history: DataFrame, as_of_day: Column, retention_days: int,
    refetched: DataFrame | None = None, scored: DataFrame | None = None,
) -> DataFrame:
    """Union stored, re-fetched and just-scored rows, keep the retention window and one row per
    (url, date): the last writer wins, the higher score among its own rows. Merging the same day
    again changes nothing."""
    parts = [(STORED, history), (REFETCHED, refetched), (SCORED, scored)]
    tagged = [
        part.select("url", "date", "score", F.lit(rank).alias("writer"))
        for rank, part in parts if part is not None
    ]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part)
    rows = retain(rows, as_of_day, retention_days)

    def by(rank: int) -> Column:
        return F.max(F.when(F.col("writer") == rank, F.col("score")))

    return rows.groupBy("url", "date").agg(
        F.coalesce(by(SCORED), by(REFETCHED), by(STORED)).alias("score")
    )


def growth_by_url(history: DataFrame) -> DataFrame:
    """Growth score of every url with at least two history rows: (url, growth_score)."""
    newest = Window.partitionBy("url").orderBy(F.col("date").desc())
    pair = history.withColumn("rn", F.row_number().over(newest)).where("rn <= 2")
    return pair.groupBy("url").agg(
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("latest"),
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("previous"),
    ).where("previous is not null").select(
        "url", growth_score(F.col("latest"), F.col("previous")).alias("growth_score")
    )


def score_runs(history: DataFrame) -> DataFrame:
    """(url, days_losing, days_stale) from day-over-day steps, newest first.

    A step is losing when the score dropped, stale when it is equal or rose by under 1 %. The walk
    stops at the first bigger rise; the answer is the length of the last run it went through.
    """
    newest = Window.partitionBy("url").orderBy(F.col("date").desc())
    older = F.lead("score").over(newest)
    step = (
        F.when(older.isNull(), None)
        .when(F.col("score") < older, "losing")
        .when(
            (F.col("score") == older)
            | (
                F.abs(F.col("score") - older)
                / F.greatest(older.cast("double"), F.lit(1.0)) < 0.01
            ),
            "stale",
        )
        .otherwise("growth")
    )
    steps = history.select("url", "date", "score", step.alias("step"))
    until_growth = steps.withColumn(
        "stopped", F.sum(F.when(F.col("step") == "growth", 1).otherwise(0)).over(newest)
    ).withColumn("new_run", F.when(F.col("step") == F.lag("step").over(newest), 0).otherwise(1))
    kept = until_growth.withColumn("run", F.sum("new_run").over(newest)).withColumn(
        "counts", F.col("step").isNotNull() & (F.col("stopped") == 0)
    )
    runs = kept.groupBy("url", "run").agg(
        F.count_if("counts").alias("days"), F.max(F.when(F.col("counts"), F.col("step"))).alias("step")
    )
    last = runs.groupBy("url").agg(
        F.max_by("days", F.when(F.col("days") > 0, F.col("run"))).alias("days"),
        F.max_by("step", F.when(F.col("days") > 0, F.col("run"))).alias("step"),
    )
    return last.select(
        "url",
        F.when(F.col("step") == "losing", F.col("days")).otherwise(F.lit(0)).cast("bigint").alias("days_losing"),
        F.when(F.col("step") == "stale", F.col("days")).otherwise(F.lit(0)).cast("bigint").alias("days_stale"),
    )
