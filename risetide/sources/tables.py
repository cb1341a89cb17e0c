"""Day-partitioned tables of the lake, CSV and JSON interchange, readiness checks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scoring import as_of_day
from ..operators.clean import union_sources
from ..schema import (
    KEYWORDS_SCHEMA, POST_COLUMNS, POSTS_SCHEMA, RAW_SCHEMA, SCORES_SCHEMA, TRACKED_SCHEMA,
    VALID_SOURCES,
)

RAW, POSTS, SCORES, KEYWORDS, TRACKED = "posts_raw", "posts", "post_scores", "keyword_history", "tracked"


class Lake:
    """Paths of the tables under one root folder (any file system Spark can reach)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, schema: str) -> DataFrame:
        """The table, or an empty frame of the same schema when nothing was written yet."""
        if not _path_exists(self.spark, self.path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def raw(self) -> DataFrame:
        return self.read(RAW, f"{RAW_SCHEMA}, landing_rank int, seq bigint, pos bigint, date date, batch int")

    def posts(self) -> DataFrame:
        return self.read(POSTS, POSTS_SCHEMA)

    def scores(self) -> DataFrame:
        return self.read(SCORES, SCORES_SCHEMA)

    def keyword_history(self) -> DataFrame:
        return self.read(KEYWORDS, KEYWORDS_SCHEMA)

    def tracked_versions(self) -> DataFrame:
        return self.read(TRACKED, f"{TRACKED_SCHEMA}, version date")

    def tracked_before(self, day: Column) -> DataFrame:
        """The registry as the latest run before `day` left it."""
        older = self.tracked_versions().where(F.col("version") < day)
        newest = older.agg(F.max("version")).scalar()
        return older.where(F.col("version") == newest).drop("version")

    def tracked(self) -> DataFrame:
        return self._version(max(self.partitions(TRACKED, "version"), default=None))

    def _version(self, version: date | None) -> DataFrame:
        return self.tracked_versions().where(F.col("version") == F.lit(version)).drop("version")

    def partitions(self, table: str, key: str) -> list[date]:
        """The days a table has a partition of, newest first; lists one folder, reads no file."""
        fs, folder = _file_system(self.spark, self.path(table))
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found = [n.partition("=")[2] for n in names if n.startswith(f"{key}=")]
        return sorted((date.fromisoformat(v) for v in found if v[:1].isdigit()), reverse=True)

    def begin(self, day: date) -> None:
        """A run of a day starts. Here its tables change one by one; DayLake changes them together."""

    def commit(self) -> None:
        """A run of a day has written all its tables."""

    def drop_partition(self, table: str, *folders: str) -> None:
        fs, folder = _file_system(self.spark, "/".join([self.path(table), *folders]))
        fs.delete(folder, True)

    def write(self, df: DataFrame, table: str, *partition_by: str) -> None:
        """Replace exactly the partitions present in `df`."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *partition_by
        ).parquet(self.path(table))

    def drop_before(self, table: str, partition: str, oldest: date) -> list[str]:
        """Delete day partitions older than `oldest`; lists one folder, touches no data."""
        fs, folder = _file_system(self.spark, self.path(table))
        dropped = []
        if not fs.exists(folder):
            return dropped
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            key, _, value = name.partition("=")
            if key == partition and value < oldest.isoformat():
                fs.delete(status.getPath(), True)
                dropped.append(value)
        return sorted(dropped)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


# --- CSV and JSON interchange -------------------------------------------------------


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Raw post CSV with quoted line breaks: short rows are padded with nulls, over-long rows are
    dropped, and an unreadable path gives None. `seq` is the row position."""
    try:
        rows = spark.read.schema(f"{RAW_SCHEMA}, _extra string").csv(
            path, header=True, multiLine=True, escape='"', mode="PERMISSIVE",
            enforceSchema=True, encoding="UTF-8",
        )
    except AnalysisException:
        return None
    return rows.where(F.col("_extra").isNull()).drop("_extra").withColumn(
        "seq", F.monotonically_increasing_id()
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Export every row, with header (array columns are left out)."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.select(*flat).write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_scores_csv(spark: SparkSession, path: str) -> DataFrame:
    """Score history CSV (url, date, score); empty when the file is missing."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], SCORES_SCHEMA)
    return spark.read.schema(SCORES_SCHEMA).csv(path, header=True, escape='"')


_TRACKED_JSON = "map<string,struct<category:string,source:string,added_date:string>>"
_KEYWORDS_JSON = "map<string,map<string,bigint>>"


def tracked_from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """Registry rows of JSON texts shaped {url: {category, source, added_date}}."""
    parsed = documents.select(F.explode(F.from_json(column, _TRACKED_JSON)).alias("url", "m"))
    return parsed.select(
        "url", "m.category", "m.source", F.to_date("m.added_date").alias("added_date")
    )


def keyword_history_from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """History rows of JSON texts shaped {date: {term: count}}."""
    by_day = documents.select(F.explode(F.from_json(column, _KEYWORDS_JSON)).alias("day", "terms"))
    return by_day.select(F.to_date("day").alias("date"), F.explode("terms").alias("term", "cnt"))


def keyword_history_to_json(history: DataFrame) -> DataFrame:
    """One flat JSON object per (date, term): nesting a whole day would put it in one value."""
    return history.select(F.to_json(F.struct("date", "term", "cnt")).alias("value"))


def tracked_to_json(tracked: DataFrame) -> DataFrame:
    """One JSON object {url: {category, source, added_date}} per tracked url."""
    meta = F.struct("category", "source", F.col("added_date").cast("string").alias("added_date"))
    return tracked.select(F.to_json(F.create_map("url", meta)).alias("value"))


# --- landing and readiness ------------------------------------------------------------


def land_raw(
    lake: Lake, batches: list[DataFrame], day: str | date | datetime, sources: list[str] = VALID_SOURCES,
) -> None:
    """Write the day's raw batches in landing order. They form batch 0 of their source and day, and
    replace those of `sources` that are there already, also where the new ones are empty; streamed
    micro-batches are numbered from 1."""
    rows = union_sources(*batches)
    if "pos" not in rows.columns:
        rows = rows.withColumn("pos", F.lit(0).cast("bigint"))
    rows = rows.select(*POST_COLUMNS, "landing_rank", "seq", "pos")
    named = lake.spark.range(1).select(as_of_day(day).cast("string")).first()[0]
    for source in sources:
        lake.drop_partition(RAW, f"source={source}", f"date={named}", "batch=0")
    rows = rows.withColumn("score", F.col("score").cast("string")).withColumn("date", as_of_day(day))
    lake.write(rows.withColumn("batch", F.lit(0)), RAW, "source", "date", "batch")


def readiness(raw: DataFrame, sources: list[str] | None = None, require_all: bool = True) -> DataFrame:
    """(date, n_sources, ready): does the day have rows from every (or any) required source?"""
    wanted = sources or VALID_SOURCES
    counts = [F.count_if(F.col("source") == s) for s in wanted]
    present = [F.when(c > 0, 1).otherwise(0) for c in counts]
    n = sum(present[1:], present[0])
    per_day = raw.groupBy("date").agg(n.cast("bigint").alias("n_sources"))
    need = len(wanted) if require_all else 1
    return per_day.withColumn("ready", F.col("n_sources") >= need)


def day_ready(raw: DataFrame, day: Column, require_all: bool = True) -> bool:
    """Whether a day can be processed (reads that day's partitions only)."""
    row = readiness(raw.where(F.col("date") == day), require_all=require_all).first()
    return bool(row and row["ready"])


def _newest_file(df: DataFrame, day: Column):
    try:
        newest = df.where(F.col("date") == day).select(
            F.max("_metadata.file_modification_time").alias("t")
        )
    except AnalysisException:   # an empty stand-in for a table that was never written
        return None
    return newest.first()["t"]


def listed_days(df: DataFrame) -> DataFrame:
    """(date, written): the days of a stored table, by the time of their newest file, newest first."""
    return df.groupBy("date").agg(F.max("_metadata.file_modification_time").alias("written")).orderBy(
        F.col("written").desc(), F.col("date").desc())


def stale_days(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """(date, stale) of every day with raw rows: whether its posts are missing or older than these."""
    landed = raw.groupBy("date").agg(F.max("_metadata.file_modification_time").alias("landed"))
    done = posts.groupBy("date").agg(F.max("_metadata.file_modification_time").alias("done"))
    return landed.join(done, "date", "left").select(
        "date", (F.col("done").isNull() | (F.col("landed") > F.col("done"))).alias("stale"))


def is_stale(raw: DataFrame, posts: DataFrame, day: Column) -> bool:
    """True when the day's posts are missing or older than its raw rows."""
    processed = _newest_file(posts, day)
    if processed is None:
        return True
    landed = _newest_file(raw, day)
    return landed is not None and landed > processed
