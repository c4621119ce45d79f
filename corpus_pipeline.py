"""A corpus pipeline from the llm operators: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm import decontam, exact, exchange as X, mixing, neardup, toxicity


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text are in dropped(doc_id, th: hash of the text), which is broadcast only if it was counted to be
    small. Other rows with the same doc_id, or also without one, stay."""
    dropped = X.cut(dropped.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    return docs.join(X.small_side(dropped), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_anti")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_rows(docs, toxicity.score(docs, model, by_text=True).filter("score >= 0.3"))


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the least doc_id stays, and of its rows one."""
    return exact.keep_first(docs)


def stage_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 80 % of their 5-word shingles the least doc_id stays."""
    return drop_rows(docs, neardup.dedup_near(docs, by_text=True).filter("not kept"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark's windows cover a twentieth or more go."""
    return decontam.remove_documents(docs, decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", stage_toxicity), ("exact", stage_exact), ("near", stage_neardup), ("decontaminate", stage_decontaminate), ("mixing", stage_mixing)]
#: The toxicity classifier is fitted, so no SQL says which documents go.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{X.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
