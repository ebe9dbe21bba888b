"""A training-data pipeline: five filtering stages over ``documents``, each written before the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, mixing, neardup, quality
from tessera.llm.store import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier, trained on all labels, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(docs, labels, "quality", F.lit(True))
    rows, score = quality.scored(docs.select(COLUMNS), weights)
    return rows.filter(F.col(score) >= 0.5).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated chunks of lines out of the texts; documents that lose all their text go."""
    done = linededup.line_dedup(docs.select(COLUMNS))
    kept = done.filter("_chunks_removed = 0 OR length(trim(text)) > 0")
    size = F.when(F.col("_chunks_removed") > 0, F.length("text").cast("long"))
    return kept.withColumn("n_chars", F.coalesce(size, "n_chars")).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest number, of each component of near-duplicates."""
    classes = neardup.near_duplicates(docs, size=5, percent=80)
    gone = classes.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(COLUMNS), benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words (repeats counted)."""
    mixed = mixing.mix(docs.select(COLUMNS))
    return mixed.filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
]

#: Trained models and hashed retrieval have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, through tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
