"""Tables kept in folders: changes rewrite the folders that they touch, retention drops whole ones.

A keyed table is Parquet in folders by a hash of its key. A batch of changes is mapped to its
folders; only those are read, judged once and overwritten, so ten changed rows cost ten folders of
a table of any size. A table by day (`write_by_day`) loses its expired days without reading them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from feedspan.operators import changes
from feedspan.operators.keys import highest, is_serial
from feedspan.sources.storage import staged

FOLDER = "key_folder"


def _folders(spark: SparkSession, path: str, column: str) -> dict[str, object]:
    """Value of the partition column -> Hadoop path, for the folders of a table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    paths = [s.getPath() for s in files.listStatus(root) if s.isDirectory()]
    return {p.getName().split("=", 1)[1]: p for p in paths if p.getName().startswith(f"{column}=")}


def _drop(spark: SparkSession, path: str, column: str, values: Sequence[str]) -> list[str]:
    """Delete folders of a table; nothing in them is read."""
    there = _folders(spark, path, column)
    gone = [v for v in values if v in there]
    for v in gone:
        there[v].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there[v], True)
    return gone


def _overwrite(rows: DataFrame, path: str, column: str) -> None:
    """Replace the folders that `rows` has rows for, and no others."""
    rows.write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


class KeyedTable:
    """Rows of `schema` at `path`, in `folders` folders by the hash of `key`."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], folders: int = 256) -> None:
        self.spark, self.path, self.schema, self.key, self.folders = spark, path, schema, list(key), folders

    def folder(self) -> Column:
        """The folder of a row; equal keys, also of other numeric types, share one."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.folders)).cast("int")

    def create(self, rows: DataFrame) -> KeyedTable:
        """Write the whole table: one file a folder, unless a folder is large enough for several tasks."""
        placed = rows.select(*self.schema.names).withColumn(FOLDER, self.folder())
        placed.hint("rebalance", FOLDER).write.partitionBy(FOLDER).mode("overwrite").parquet(self.path)
        return self

    def _files(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(FOLDER, IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().select(*self.schema.names)

    def _touched(self, batch: DataFrame) -> tuple[list[int], DataFrame]:
        """The folders a batch touches, at most `folders` of them, and the table's rows there."""
        numbers = sorted(r[0] for r in batch.select(self.folder()).distinct().collect())
        return numbers, self._files().filter(F.col(FOLDER).isin(numbers)).select(*self.schema.names)

    def _rewrite(self, batch: DataFrame, change) -> changes.Change:
        numbers, part = self._touched(batch)
        done = change(part)
        kept = done.table.withColumn(FOLDER, self.folder())
        left = {r[0] for r in kept.select(FOLDER).distinct().collect()}
        _overwrite(kept, self.path, FOLDER)
        # A folder without rows left is none that the write above replaces.
        _drop(self.spark, self.path, FOLDER, [str(n) for n in numbers if n not in left])
        return done

    def update(
        self, batch: DataFrame, set_columns: Sequence[str], order: Sequence[str], fixed=None, on: Sequence[str] = ()
    ) -> changes.Change:
        """`keyed_update` on the touched folders; the result has the rows of those alone. `on` may add to the key."""
        return self._rewrite(batch, lambda part: changes.keyed_update(
            part, batch, on or self.key, set_columns, order, fixed, stage=True))

    def update_versions(
        self, batch: DataFrame, set_columns: Sequence[str], order: Sequence[str], fixed=None, on: Sequence[str] = ()
    ) -> changes.Change:
        """`versioned_update` on the touched folders."""
        return self._rewrite(batch, lambda part: changes.versioned_update(
            part, batch, on or self.key, set_columns, order, fixed=fixed, stage=True))

    def delete(self, doomed: DataFrame, on: Sequence[str] = ()) -> changes.Change:
        """`delete_by_keys` on the touched folders."""
        return self._rewrite(doomed, lambda part: changes.delete_by_keys(part, doomed, on or self.key, stage=True))

    def insert(self, batch: DataFrame, order: Sequence[str]) -> changes.Change:
        """`insert_unique` on the table's key; new rows are appended to their folders, none is rewritten."""
        _, part = self._touched(batch)
        first = highest(self.read()) if is_serial(part, batch) else None
        flagged = staged(changes.flag_unique(part, batch, self.key, order, first=first), "judged-rows")
        accepted, rejected = (flagged.filter(x).drop("__ok") for x in ("__ok", "NOT __ok"))
        new = changes.append_rows(self.read().limit(0), accepted).table
        new.withColumn(FOLDER, self.folder()).repartition(FOLDER).write.partitionBy(FOLDER).mode("append").parquet(self.path)
        return changes.Change(self.read(), accepted, rejected)


def drop_days_before(spark: SparkSession, path: str, day: date) -> list[str]:
    """Drop the folders of a `write_by_day` table that lie before a day; returns their days."""
    return _drop(spark, path, "day", sorted(d for d in _folders(spark, path, "day") if d < day.isoformat()))


def purge_days(
    spark: SparkSession, path: str, schema: StructType, as_of: datetime, minutes_kept: int, time_column: str = "created_at"
) -> list[str]:
    """Retention of a `write_by_day` table: rows up to the cutoff go.

    Days before the cutoff's own are dropped as folders, unread. Of the cutoff's day the later rows
    are written anew; other days aren't touched.
    """
    cutoff = as_of - timedelta(minutes=minutes_kept)
    dropped = drop_days_before(spark, path, cutoff.date())
    day = cutoff.date().isoformat()
    if day not in _folders(spark, path, "day"):
        return dropped
    with_day = StructType([*schema.fields, StructField("day", DateType())])
    rows = spark.read.schema(with_day).parquet(path).filter(F.col("day") == F.lit(cutoff.date()))
    later = staged(rows.filter(F.col(time_column) > F.lit(cutoff).cast(schema[time_column].dataType)), "kept-rows")
    if later.isEmpty():
        return dropped + _drop(spark, path, "day", [day])
    _overwrite(later, path, "day")
    return dropped
