"""Small summary shapes used by several reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedspan.sources.storage import staged


def one_row(df: DataFrame, *aggs: Column) -> Column:
    """A global summary as a scalar struct column: runs once, needs no join."""
    return df.agg(*aggs).select(F.struct("*").alias("s")).scalar()


def most_common(df: DataFrame, column: str) -> Column:
    """The most frequent value as a scalar; ties go to the smallest value, NULLs last."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(1)
    return first.select(column).scalar()


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def latest_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row with the largest `order` values per key, by one map-side combined grouping."""
    parts = list(dict.fromkeys([*order, *columns]))
    return (
        df.groupBy(key)
        .agg(F.max(F.struct(*parts)).alias("__last"))
        .select(key, *[F.col(f"__last.{c}").alias(c) for c in columns])
    )


def facet_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct value combinations of a table's columns."""
    return df.select(*columns).distinct()


def numbered_facet(df: DataFrame, column: str, number: str = "id") -> DataFrame:
    """Distinct values numbered 1..n in value order, NULL first.

    Values are cut into even ranges, one per shuffle partition, and numbered inside each; a range
    is shifted by the sizes of all earlier ones, a list as long as there are ranges. The ranges
    are written once, since a second pass could cut them elsewhere.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.select(column).distinct().repartitionByRange(ranges, F.asc_nulls_first(column))
    values = staged(cut.withColumn("__p", F.spark_partition_id()), "facet-ranges")
    sizes = (
        values.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.collect_list(F.struct("__p", "n")).alias("s")).scalar()
    )
    earlier = F.filter("__sizes", lambda s: s["__p"] < F.col("__p"))
    shift = F.reduce(earlier, F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    within = F.row_number().over(W.partitionBy("__p").orderBy(F.asc_nulls_first(column)))
    return values.withColumn("__sizes", sizes).select((within + shift).cast("bigint").alias(number), column)
