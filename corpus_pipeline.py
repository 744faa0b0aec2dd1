"""From raw documents to a training mix: quality, line dedup, near duplicates, benchmark passages, source weights."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shotline.llm import decontam, jaccard, lines, mixing, shared
from shotline.llm.queries import quality_scores


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3)."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), list(docs.columns))
    return scores.filter("__score >= 0.3").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(docs)


STAGES = [
    ("quality classifier", drop_bad_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: SQL can't say what a trained model decides; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
