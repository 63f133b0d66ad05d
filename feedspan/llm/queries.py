"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedspan.llm.alignment import alignment_digests
from feedspan.llm.bpe import bpe_digests
from feedspan.llm.common import table
from feedspan.llm.crf_quality import quality_scores
from feedspan.llm.embeddings import embedding_duplicates
from feedspan.llm.fill_in_middle import fim_digests
from feedspan.llm.html_text import extract_pages
from feedspan.llm.language_id import language_id
from feedspan.llm.license_scan import license_scan
from feedspan.llm.minhash import duplicate_classes
from feedspan.llm.mixing import take_counts, weight_table
from feedspan.llm.packing import pack
from feedspan.llm.quality_rules import quality_rules
from feedspan.llm.toxicity import toxicity_scores

#: Target weights of the mix; what isn't named weighs 1.
WEIGHTS = {
    "domain": {"domain0": 2.0, "domain1": 1.0, "domain2": 1.0, "domain3": 0.5},
    "lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0},
    "source": {"src0": 0.5},
}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = take_counts(table(spark, sf_dir, "documents"), weights=weight_table(spark, WEIGHTS))
    return taken.select("doc_id", "leaf_domain", "leaf_lang", "leaf_source", "n_tokens", "taken")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_bpe": op12_bpe,
    "op13_alignment": op13_alignment,
}
