"""Batch key lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_lookup(
    table: DataFrame,
    keys: DataFrame,
    on: Sequence[str],
    where: Column | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """Rows of `table` whose key columns occur in `keys`.

    A semi join on distinct keys: each task keeps a repeated key once before the shuffle, so a key
    that most of the batch asks for is one row a task and not one large group. A small batch is
    broadcast by size, and a large one is shuffled with the table. With `ignore_case` text keys are
    compared in lower case.
    """
    norm = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    wanted = keys.select(*[norm(F.col(c)).alias(f"__k{i}") for i, c in enumerate(on)]).distinct()
    match = F.lit(True)
    for i, c in enumerate(on):
        match = match & (norm(F.col(c)) == F.col(f"__k{i}"))
    found = table if where is None else table.filter(where)
    return found.join(wanted, match, "left_semi")
