"""Joins that split hot keys themselves, for plans AQE cannot split.

AQE splits a skewed join only where both inputs come straight from a shuffle. A side
that was just aggregated on the join key does not, so its hot keys are sliced here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(big: DataFrame, key: str, min_rows: int = 1_000_000) -> DataFrame:
    """(key, slices) of all keys with more than `min_rows` rows."""
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > min_rows)
    return counts.select(key, F.ceil(F.col("__n") / F.lit(min_rows)).cast("int").alias("__slices"))


def join_sliced(
    big: DataFrame, per_key: DataFrame, key: str, spread: str, min_rows: int = 1_000_000
) -> DataFrame:
    """Inner join of `big` with one row per key, hot keys of `big` cut into slices.

    Rows of a hot key go to a slice by hash of `spread`, and the key's row is copied once
    per slice. The list of hot keys has at most rows / `min_rows` entries; Spark broadcasts
    it when its measured size is small and shuffles it otherwise.
    """
    hot = hot_keys(big, key, min_rows)
    n = F.coalesce("__slices", F.lit(1))
    left = big.join(hot, key, "left").withColumn("__slice", F.pmod(F.xxhash64(spread), n).cast("int"))
    right = per_key.join(hot, key, "left").withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), n - 1))
    )
    return left.drop("__slices").join(right.drop("__slices"), [key, "__slice"]).drop("__slice")
