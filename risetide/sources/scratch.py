"""Intermediate tables of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set, in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="risetide-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


class Scratch:
    """Written tables that cut the lineage of a loop: they survive lost executors, and reading them
    back gives Spark real sizes to plan with."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self._spark = spark
        self._root = root or f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self._root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        saved = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(saved)] = path
        return saved

    def forget(self, *saved: DataFrame) -> None:
        """Delete tables the loop no longer reads."""
        for df in saved:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df)))
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
