"""Tables on shared storage: date-partitioned writes and idempotent stream appends."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspan.session import shared_dir


def write_by_day(df: DataFrame, path: str, time_column: str = "created_at", mode: str = "append") -> None:
    """Write partitioned by day, so retention and time filters skip whole folders.

    Rows are spread by (day, hash) rather than by day alone: AQE's rebalance splits a
    day that holds most of the rows over several tasks and files.
    """
    dated = df.withColumn("day", F.to_date(time_column))
    dated.hint("rebalance", "day").write.partitionBy("day").mode(mode).parquet(path)


def write_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, path: str | None = None, mode: str = "overwrite"
) -> None:
    """Save as a bucketed table; joins and aggregates on the key then need no shuffle."""
    writer = df.write.bucketBy(buckets, key).sortBy(key).mode(mode).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own folder; a replay overwrites the same folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, keep_batch: bool = False) -> DataFrame:
    """All micro-batches, if wanted with the number of each row's batch."""
    df = spark.read.schema(f"{schema}, batch_id bigint").option("basePath", path).parquet(path)
    return df if keep_batch else df.drop("batch_id")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back.

    For results that are costly to compute and read several times: later readers take
    only the columns they need, and a lost executor costs a re-read, not a recompute.
    """
    return restaged(df, shared_dir(df.sparkSession, purpose))


def restaged(df: DataFrame, path: str) -> DataFrame:
    """Write a frame to a folder in place of what it held, and read it back: a stream keeps one micro-batch there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Writes of the session compress harder, and their shuffle files go when they end.

    Otherwise shuffle files stay until the driver happens to collect its garbage, which a job of
    several writes may never see.
    """
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
