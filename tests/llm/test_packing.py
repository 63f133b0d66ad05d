import itertools

import numpy as np
from pyspark.sql import functions as F

from feedspan.llm.packing import best_boundaries, pack

from helpers import awkward, documents


def test_boundaries_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        upper, count = np.arange(1, 9) * 3, rng.integers(0, 9, 8)
        for k in (1, 2, 3):
            def padded(ends):
                return sum(int(c) * min(e for e in ends if e >= u) for u, c in zip(upper, count, strict=True))

            best = min(padded((*cut, 24)) for n in range(k) for cut in itertools.combinations(upper[:-1].tolist(), n))
            assert padded(best_boundaries(upper, count, k)) == best


def test_batches_hold_their_budget_and_every_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pack(docs, buckets=4, token_budget=2000, shard_rows=20).toPandas()
    assert len(got) == docs.count() and got.doc_id.is_unique
    placed = got[got.bucket_len > 0]
    assert (placed.padding == placed.bucket_len - placed.n_tokens).all() and (placed.padding >= 0).all()
    assert placed.bucket_len.nunique() <= 4
    for _, batch in placed.groupby("batch_id"):
        end = batch.bucket_len.iloc[0]
        assert batch.bucket_len.nunique() == 1 and (len(batch) * end <= 2000 or len(batch) == 1)
        assert sorted(batch.pos) == list(range(len(batch)))
    # Only the last batch of a bucket isn't full.
    for end, rows in placed.groupby("bucket_len"):
        full = max(1, 2000 // end)
        assert sum(rows.groupby("batch_id").size() < full) <= 1


def test_awkward_rows(spark):
    got = pack(awkward(spark)).collect()
    assert len(got) == 12
    assert all((r.batch_id is None) == (r.n_tokens == 0) for r in got)
    assert pack(documents(spark, [])).count() == 0
    assert pack(documents(spark, [(1, None)])).first().bucket_len == 0
    assert pack(awkward(spark), tokens=F.length("text")).filter("n_tokens > 100000").count() == 1


def test_one_huge_text_leaves_the_other_boundaries(spark):
    lengths = [n for n in range(1, 301) for _ in range(1 + n % 3)] + [200_000]
    docs = documents(spark, [(i, "x" * n) for i, n in enumerate(lengths)])
    got = pack(docs, tokens=F.length("text"), buckets=4).agg(F.sum("padding")).first()[0]
    upper, count = np.unique(lengths, return_counts=True)
    rows = np.concatenate([[0], np.cumsum(count)])
    best = np.array([0.0] + [np.inf] * len(upper))
    for _ in range(4):
        best = np.array([0.0] + [min(best[i] + upper[j] * (rows[j + 1] - rows[i]) for i in range(j + 1)) for j in range(len(upper))])
    assert got == best[-1] - sum(lengths)


def test_boundaries_of_many_lengths():
    rng = np.random.default_rng(8)
    upper = np.unique(rng.integers(1, 3000, 1500))
    count = rng.integers(1, 50, len(upper))
    rows = np.concatenate([[0], np.cumsum(count)])
    best = np.concatenate([[0], upper * rows[1:]])
    for _ in range(6):
        best = np.array([0, *((best[: j + 1] + upper[j] * (rows[j + 1] - rows[: j + 1])).min() for j in range(len(upper)))])
    ends = np.array(best_boundaries(upper, count, 7))
    assert (ends[np.searchsorted(ends, upper)] * count).sum() == best[-1]
