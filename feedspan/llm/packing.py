"""Packing into length buckets: boundaries that minimise padding, token-budget batches inside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspan.llm.common import word_count
from feedspan.sources.storage import staged


def best_cuts(best: np.ndarray, upper: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over i <= j of best[i] + upper[j] * rows in bins i..j, for every j, and the least such i.

    The least i never falls as j grows, so the i of a middle j bounds those of both sides: divide
    and conquer, one level of all sides at a time.
    """
    n = len(upper)
    now, cut = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    lo, hi, first, last = (np.array([x]) for x in (0, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(last, mid) - first + 1
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(mid)), size)
        i = np.arange(len(part)) - start[part] + first[part]
        total = best[i] + upper[mid][part] * (rows[mid + 1][part] - rows[i])
        now[mid] = np.minimum.reduceat(total, start)
        hits = np.flatnonzero(total == now[mid][part])
        cut[mid] = i[hits[np.unique(part[hits], return_index=True)[1]]]
        lo, hi, first, last = (
            np.concatenate(x) for x in ((lo, mid + 1), (mid, hi), (first, cut[mid]), (cut[mid], last)))
        some = lo < hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return now, cut


def best_boundaries(upper: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Bucket upper ends, chosen among `upper` (ascending), with the least padded total.

    Dynamic programming over the histogram: with k buckets the rows up to bin j cost
    min over i of (cost of k-1 buckets up to i) + upper[j] * rows in (i, j].
    """
    n = len(upper)
    upper = np.asarray(upper, dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    now = upper * rows[1:]  # one bucket
    cuts = [np.zeros(n, dtype=np.int64)]
    for _ in range(min(buckets, n) - 1):
        # An unused bucket costs nothing: best[0] stays 0.
        now, cut = best_cuts(np.concatenate([[0], now]), upper, rows)
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(upper[j - 1]))
        j = int(cut[j - 1])
    return sorted(ends)


def pack(
    docs: DataFrame,
    tokens: Column | None = None,
    buckets: int = 16,
    token_budget: int = 65_536,
    shard_rows: int = 20_000,
) -> DataFrame:
    """Bucket, batch, position and padding of every row.

    docs: doc_id and text (or what `tokens` needs; default: words of text). The boundaries
    are optimal over all lengths that occur; the driver holds one count for each of them (d
    lengths take d * d / 2 tokens at least, so even 10^12 tokens have at most 1.5 million). A batch of a bucket has budget // bucket_len rows,
    one at least, so a row longer than the budget is alone in its batch. Rows of no tokens need
    no place: bucket_len 0, batch_id and pos null. Repeated rows and null ids are rows like any
    other. Empty input: no rows. Inside a bucket rows are dealt to shards of about `shard_rows`
    by hash and numbered there; shard offsets make the numbers consecutive, so no bucket is
    sorted in one task.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    lengths = staged(docs.select("doc_id", F.coalesce(tokens.cast("long"), F.lit(0)).alias("n_tokens")), "lengths")
    histogram = lengths.filter("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").toArrow()
    upper, count = (histogram.column(c).to_numpy() for c in ("n_tokens", "count"))
    ends = best_boundaries(upper, count, buckets) if len(upper) else []

    bucket_len, shards, per_batch, number = F.when(F.col("n_tokens") <= 0, 0), None, None, None
    for k, end in enumerate(ends):
        bucket_len = bucket_len.when(F.col("n_tokens") <= end, end)
        inside = int(count[(upper <= end) & (upper > (ends[k - 1] if k else 0))].sum())
        here = F.col("bucket_len") == end
        base = F if shards is None else None
        values = (max(1, -(-inside // shard_rows)), max(1, token_budget // end), k)
        shards, per_batch, number = (
            (base or was).when(here, F.lit(v)) for was, v in zip((shards, per_batch, number), values, strict=True)
        )
    placed = lengths.withColumn("bucket_len", bucket_len.otherwise(0).cast("long"))
    free = placed.filter("bucket_len = 0").select(
        "doc_id", "n_tokens", "bucket_len",
        *(F.lit(None).cast("long").alias(c) for c in ("batch_id", "pos")), F.lit(0).cast("long").alias("padding"))
    if not ends:
        return free
    order = F.xxhash64(F.col("doc_id"), F.col("n_tokens"))
    dealt = placed.filter("bucket_len > 0").withColumn("order", order).withColumn("shard", F.pmod(order, shards))
    shard = Window.partitionBy("bucket_len", "shard")
    before = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("bucket_len", "shard").count()
        .withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    )
    numbered = (
        dealt.withColumn("rank", F.row_number().over(shard.orderBy("order", "doc_id")) - 1)
        .join(offsets, ["bucket_len", "shard"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    batch = F.floor(F.col("rank") / per_batch).cast("long")
    return numbered.select(
        "doc_id", "n_tokens", "bucket_len",
        # The bucket's number stands in the upper bits, so batch ids are unique over all buckets.
        (F.shiftleft(number.cast("long"), 48) + batch).alias("batch_id"),
        (F.col("rank") % per_batch).cast("long").alias("pos"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    ).unionByName(free)
