"""Pipeline from raw documents to packed training batches; each stage is one of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedspan.llm.common import table
from feedspan.llm.crf_quality import keep_good
from feedspan.llm.minhash import drop_duplicates
from feedspan.llm.mixing import mix, weight_table
from feedspan.llm.packing import pack
from feedspan.llm.queries import WEIGHTS
from feedspan.llm.toxicity import drop_toxic
from feedspan.sources.storage import staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return drop_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights; a document taken for two epochs is there twice."""
    return mix(docs, weights=weight_table(spark, WEIGHTS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of each document."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Two stages are trained models and one compares signatures: tested against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
