"""Incremental landing of forum submissions with Structured Streaming."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import as_of_day
from ..schema import POST_COLUMNS, SUBMISSION_SCHEMA
from ..sources.landing import forum_posts
from ..sources.tables import RAW, Lake


def stream_submissions(
    spark: SparkSession, folder: str, lake: Lake, checkpoint: str, day: str | date | datetime,
) -> StreamingQuery:
    """Map every not-yet-seen JSON file under `folder` to raw posts and append them to the day.

    The file source remembers what it has read, so the query can be run again at any time. Each
    micro-batch writes its own sub-folder, replaced as a whole when a batch is retried: rows land
    exactly once. Url duplicates between batches are left to `clean_posts`; order is by
    batch number, then `seq`, so the first landed row wins.
    """
    rows = spark.readStream.schema(SUBMISSION_SCHEMA).json(folder)

    def land(batch: DataFrame, number: int) -> None:
        landed = forum_posts(batch).withColumn("pos", F.lit(0).cast("bigint")).select(
            *[c for c in POST_COLUMNS if c != "source"], F.lit(0).alias("landing_rank"), "seq", "pos",
            F.col("source"), as_of_day(day).alias("date"), F.lit(number + 1).alias("batch"),
        ).withColumn("score", F.col("score").cast("string"))
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "source", "date", "batch"
        ).parquet(lake.path(RAW))

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
