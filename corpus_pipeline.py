"""A corpus pipeline of five stages; each works on all rows the one before it kept.

Every stage takes null ids and texts, empty and very long texts, repeated rows, an empty table, and further
columns of any name; all but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risetide.llm import bpe, decontaminate, lines, quality, simhash
from risetide.llm.work import importable, new_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, null and empty texts among them. Rows are judged by
    their text alone, so equal rows stay or go together."""
    importable(spark)
    return quality.drop_junk(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; n_chars follows the text. Documents stay, also those that become
    empty; a null text stays null; rows with equal doc_id and text are one document and get the same result."""
    importable(spark)
    names = docs.columns
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id, of equal ones that
    with the smallest digest of its text. Rows equal in both are one; rows without doc_id all stay."""
    importable(spark)
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; without items all stay."""
    importable(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each row; a null text counts as
    empty."""
    importable(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: A trained model, SimHash and BPE are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return done
        path = new_path(spark, f"pipeline-{i + 1}")
        done.write.parquet(path)
        docs = spark.read.parquet(path)
