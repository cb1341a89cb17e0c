"""Shared helpers of the operators: written tables in the cluster's shared folder, and components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. Only where none is named, and driver and
    executors are one process on one machine (tests), a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{tempfile.gettempdir()}/risetide-shared"
    return named.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Python workers also look where this package was imported from, whatever folder the session began
    in. A cluster without that folder gets the package by --py-files, as any other."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a written table: lineage ends there, and a lost executor costs
    one read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def delete_table(df: DataFrame) -> None:
    """Remove a table made by saved() that nothing reads any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def text_bytes(column: Column | str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of edges (a, b).

    Alternates large-star and small-star steps until the edges are stars, which they often are at once.
    Minima are combined in the map tasks; the joins are plain inner joins that Spark may split at a hot
    node. Each round is a written table. No edges: no rows."""
    edges = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not _are_stars(edges):
        following = saved(_small_star(_large_star(edges)), name)
        delete_table(edges)
        edges = following
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is a centre, or a leaf of one centre."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.leaf").alias("leaf"), F.max("e.centre").alias("centre"))
    return nodes.agg(F.coalesce(F.max(F.col("leaf") + F.col("centre")), F.lit(0))).first()[0] <= 1


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return (both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.where("u <> v").unionByName(kept).distinct()
