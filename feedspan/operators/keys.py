"""Consecutive numbers for the rows of a batch, handed out in blocks to the tasks that write it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.sources.storage import staged

PLACES = 33  # bits of a row's place within its task, as monotonically_increasing_id has them


def numbered(rows: DataFrame, order: Sequence[str] = (), name: str = "__n") -> DataFrame:
    """The rows with 1, 2, 3 ... in `order` (as they come without one), written once and read back.

    Each task numbers the rows it writes; the number of rows before a task comes from one count per
    task, which is all the driver sees. Numbers are part of the written table, so a lost executor
    or a second read can't change them.
    """
    sorted_rows = rows.orderBy(*order) if order else rows
    placed = staged(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "numbered-rows")
    task = F.shiftright("__at", PLACES)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(task).count().collect())
    before = accumulate((n for _, n in sizes), initial=0)
    starts = [(t, b) for (t, _), b in zip(sizes, before, strict=False)] or [(-1, 0)]
    # One row per task of the write.
    blocks = F.broadcast(rows.sparkSession.createDataFrame(starts, "__task long, __before long"))
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << PLACES) - 1) + 1
    return placed.join(blocks, task == F.col("__task")).withColumn(name, number).drop("__at", "__task", "__before")


def is_serial(table: DataFrame, batch: DataFrame, column: str = "id") -> bool:
    """Whether rows of the batch need a number for the table's id."""
    return (
        column in table.columns and column not in batch.columns
        and table.schema[column].dataType.simpleString() in ("bigint", "int", "smallint")
    )


def highest(table: DataFrame, column: str = "id") -> int:
    """The largest id of a table; 0 of an empty one."""
    return table.agg(F.max(column)).first()[0] or 0


def serial_id(table: DataFrame, first: int, number: Column, column: str = "id") -> Column:
    return (F.lit(first) + number).cast(table.schema[column].dataType).alias(column)
