"""A lake whose days change as a whole.

A run of a day writes its tables to a folder of its own. The day's pointer names the run that counts and is
replaced, in one rename, when all of them are written. A run that dies leaves a folder that nothing names;
the next run of the day deletes it.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import RAW, Lake, _file_system, _path_exists

POINTER = "current"


class DayLake(Lake):
    """Lake whose state tables are read from each day's named run. Raw rows are landed as in any lake."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self._day: date | None = None
        self._run = ""
        self._written: set[str] = set()
        self._drops: list[tuple[str, str, date]] = []

    def _folder(self, *names: str) -> str:
        return "/".join([self.root, "days", *names])

    def named_runs(self) -> dict[date, str]:
        """The run that counts of each day; reads one small file a day, in one job."""
        fs, folder = _file_system(self.spark, self._folder())
        if not fs.exists(folder) or not fs.globStatus(_file_system(self.spark, self._folder("*", POINTER))[1]):
            return {}
        rows = self.spark.read.text(self._folder("*", POINTER)).select("value", F.col("_metadata.file_path").alias("path")).collect()
        return {date.fromisoformat(r.path.split("/")[-2]): r.value for r in rows}

    def _paths(self, table: str) -> dict[date, str]:
        runs = self.named_runs()
        if table in self._written:
            runs[self._day] = self._run
        paths = {day: self._folder(day.isoformat(), run, table) for day, run in runs.items()}
        return {day: path for day, path in paths.items() if _path_exists(self.spark, path)}

    def read(self, table: str, schema: str) -> DataFrame:
        if table == RAW:
            return super().read(table, schema)
        paths = list(self._paths(table).values())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def partitions(self, table: str, key: str) -> list[date]:
        return super().partitions(table, key) if table == RAW else sorted(self._paths(table), reverse=True)

    def begin(self, day: date) -> None:
        """Start a run of the day; what dead runs of it left goes."""
        self._day, self._run, self._written, self._drops = day, uuid.uuid4().hex, set(), []
        named = self.named_runs().get(day)
        fs, folder = _file_system(self.spark, self._folder(day.isoformat()))
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.isDirectory() and status.getPath().getName() != named:
                fs.delete(status.getPath(), True)

    def write(self, df: DataFrame, table: str, *partition_by: str) -> None:
        if table == RAW:
            super().write(df, table, *partition_by)
            return
        if self._day is None:
            raise ValueError("begin a day first")
        df.write.mode("overwrite").parquet(self._folder(self._day.isoformat(), self._run, table))
        self._written.add(table)

    def drop_before(self, table: str, partition: str, oldest: date) -> list[str]:
        """Days are dropped when the run is committed."""
        self._drops.append((table, partition, oldest))
        return []

    def commit(self) -> None:
        """Name the run: from here on it counts. Then older days and the run it replaces go."""
        day = self._day.isoformat()
        before = self.named_runs().get(self._day)
        fs, pointer = _file_system(self.spark, self._folder(day, POINTER))
        # a hidden file, so a run that dies here leaves nothing that is read
        staged = _file_system(self.spark, self._folder(day, f".{self._run}"))[1]
        out = fs.create(staged, True)
        out.write(bytearray(self._run.encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.FileContext.getFileContext(staged.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        files.rename(fs.makeQualified(staged), fs.makeQualified(pointer), options)
        if before and before != self._run:
            fs.delete(_file_system(self.spark, self._folder(day, before))[1], True)
        for table, _, oldest in self._drops:
            for old, path in self._paths(table).items():
                if old < oldest:
                    fs.delete(_file_system(self.spark, path)[1], True)
        self._day, self._written, self._drops = None, set(), []
