"""Quality filter, exact and near dedup, decontamination and mixing, as stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontaminate, exact, mixing, quality, simhash
from tarn.llm.shared import cut, drop


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at its threshold or above stay."""
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similar five-word shingles the document with the smallest doc_id stays."""
    return simhash.keep_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other slots or capitals, go."""
    return decontaminate.keep_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, with how often the mix takes it whole and how many words of it beyond that."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if held is not None:
            drop(held)
        held = docs
    return docs


#: A classifier and component search can't be put as SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None
