"""Pages with totals, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_PAGE = 10_000_000
MAX_PAGE_SIZE = 100


def check_page(page: int, page_size: int) -> tuple[int, int]:
    """(limit, offset) of a page, after the range checks."""
    if not 0 < page <= MAX_PAGE:
        raise ValueError("page must be greater than zero and a maximum of 10 million")
    if not 0 < page_size <= MAX_PAGE_SIZE:
        raise ValueError("page_size must be greater than zero and a maximum of 100")
    return page_size, (page - 1) * page_size


def count_of(df: DataFrame) -> Column:
    """Row count as a scalar subquery: one partial count per task, one number out."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def metadata_columns(total: Column, page: int, page_size: int) -> dict[str, Column]:
    """Paging metadata; everything is NULL when there are no records."""
    some = lambda value: F.when(total > 0, value)
    return {
        "current_page": some(F.lit(page)),
        "page_size": some(F.lit(page_size)),
        "first_page": some(F.lit(1)),
        "last_page": some(F.ceil(total / F.lit(page_size))),
        "total_records": some(total),
    }


def page_metadata(df: DataFrame, page: int, page_size: int) -> DataFrame:
    """The metadata as one row, also where the page itself is empty."""
    check_page(page, page_size)
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    columns = metadata_columns(F.col("n"), page, page_size)
    return counted.select(*[c.alias(name) for name, c in columns.items()])


def page_of(
    df: DataFrame,
    order: Sequence[Column],
    page: int = 1,
    page_size: int = 20,
    total: str | None = "total_records",
) -> DataFrame:
    """One page in order, optionally with the count of all rows.

    `order` must end in a unique key. Every task keeps its own first rows only, so
    just `page * page_size` rows per task are merged; for deep pages use `page_at` or `page_after`.
    """
    limit, offset = check_page(page, page_size)
    rows = df.orderBy(*order)
    rows = (rows.offset(offset) if offset else rows).limit(limit)
    return rows.withColumn(total, count_of(df)) if total else rows


def page_after(
    df: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence, page_size: int = 20
) -> DataFrame:
    """The page that follows the row with key values `last`; its cost does not grow with depth.

    `keys` are (column, descending) pairs ending in a unique column.
    """
    check_page(1, page_size)
    later, tied = F.lit(False), F.lit(True)
    for (name, descending), value in zip(keys, last, strict=True):
        c, v = F.col(name), F.lit(value)
        later = later | (tied & ((c < v) if descending else (c > v)))
        tied = tied & (c == v)
    order = [F.col(n).desc() if d else F.col(n).asc() for n, d in keys]
    return df.filter(later).orderBy(*order).limit(page_size)


BINS, SORTED = 4096, 100_000


def _as_long(df: DataFrame, column: str) -> Column:
    """A date, timestamp or whole number as a number in the same order."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.col(column).cast("bigint")
    raise ValueError(f"{column} is {kind}: pages by range need a date, a timestamp or a whole number")


def page_at(
    df: DataFrame, keys: Sequence[tuple[str, bool]], page: int, page_size: int = 20, total: str | None = "total_records"
) -> DataFrame:
    """One page of any depth: only the range of the first key that holds it is sorted.

    `keys` are (column, descending) pairs ending in a unique column; the first is a date, a timestamp
    or a whole number. Histograms of it, counted in the tasks, narrow the places of the page's first
    and last row down to bins of at most `SORTED` rows, or to one key value, so the sort merges few
    rows whatever the page. NULLs of the first key come last if it descends, else first.
    """
    limit, offset = check_page(page, page_size)
    (name, descending), order = keys[0], [F.col(n).desc() if d else F.col(n).asc() for n, d in keys]
    place = -_as_long(df, name) if descending else _as_long(df, name)
    placed = df.withColumn("__place", place)
    low, high, n_all, n_set = placed.agg(
        F.min("__place"), F.max("__place"), F.count(F.lit(1)), F.count("__place")).first()
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def bins(lo: int, hi: int, width: int) -> list[tuple[int, int]]:
        if (lo, hi) not in seen:
            number = F.expr(f"(__place - {lo}L) DIV {width}L")
            counted = placed.filter(F.col("__place").between(lo, hi)).groupBy(number.alias("b")).count()
            seen[lo, hi] = sorted((r["b"], r["count"]) for r in counted.collect())
        return seen[lo, hi]

    def find(rank: int) -> tuple[int, int, int]:
        """First and last key value of a bin that holds the row with this rank, and the rows before it."""
        lo, hi, before = low, high, 0
        while True:
            width = (hi - lo) // BINS + 1
            for b, n in bins(lo, hi, width):
                if before + n > rank:
                    break
                before += n
            lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
            if n <= SORTED or lo == hi:
                return lo, hi, before

    nulls = n_all - n_set
    first = offset if descending else offset - nulls  # ranks among the rows with a key
    last = min(first + limit, n_set) - 1
    if last < max(first, 0):  # nothing but NULLs, or past the end
        start, kept = (first - n_set if descending else offset), F.col("__place").isNull()
    else:
        start_lo, _, before = find(max(first, 0))
        kept = F.col("__place").between(start_lo, find(last)[1])
        start = max(first, 0) - before
        if first < 0:
            start, kept = offset, kept | F.col("__place").isNull()
        elif descending and first + limit > n_set:
            kept = kept | F.col("__place").isNull()
    rows = placed.filter(kept).drop("__place").orderBy(*order).offset(start).limit(limit)
    return rows.withColumn(total, F.lit(n_all).cast("bigint")) if total else rows


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    offset: int = 0,
    rank: str | None = None,
) -> DataFrame:
    """Rows `offset+1 .. offset+k` of every key.

    The `row_number <= n` filter makes Spark cut each key to n rows in every task
    before the shuffle, so a hot key sends n rows per task, not all of its rows.
    """
    n = "__row"
    ranked = df.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(n) <= offset + k)
    if offset:
        kept = kept.filter(F.col(n) > offset)
    return kept.withColumnRenamed(n, rank) if rank else kept.drop(n)
