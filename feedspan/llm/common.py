"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspan.sources.storage import staged

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(rows: DataFrame, stratum: Column, limit: int, seed: int = 7) -> DataFrame:
    """About `limit` rows of each stratum (all of a smaller one), chosen by a hash of doc_id.

    One count per stratum fixes a hash threshold, so no row is sorted or gathered to choose.
    Rows of a null stratum go. The number of strata must be small (labels, languages).
    """
    rows = rows.withColumn("__stratum", stratum).filter("__stratum IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("__stratum").count().collect()}
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("__stratum") == F.lit(value)) & (share < min(1.0, limit / n)))
    return rows.filter(keep).drop("__stratum")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int, rest: Column) -> DataFrame:
    """doc_id, text and label (`column`, 0 or 1) of about `limit` documents a label, for training.

    `rest` is the fold to learn from, a condition on doc_id. The ids are sampled first; their number
    is bounded, so they are broadcast and no text is shuffled to find its label. A label given twice
    counts once, and so does a document; documents without a text or label don't count.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias(column)).filter(F.col(column).isin(0, 1) & rest)
    ids = staged(bounded_sample(known.distinct(), F.col(column), limit), "label-sample")
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    return staged(texts.groupBy("doc_id", column).agg(F.min("text").alias("text")), "training-texts")
