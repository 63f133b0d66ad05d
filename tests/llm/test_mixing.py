import collections
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from feedspan.llm.mixing import LEAF, leaf_budgets, mix, take_counts, weight_table

from helpers import awkward, documents, prose

WEIGHTS = {"domain": {"a": 3.0, "b": 1.0}, "lang": {"en": 2.0, "xx": 0.0}, "source": {"s1": 5.0}}


def fill(children, budget):
    """Water filling by rounds: full children drop out, the rest share what is left."""
    out, open_ = {}, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= budget * w / total + 1e-9}
        if not full:
            return out | {k: budget * w / total for k, (c, w) in open_.items()}
        out |= full
        budget -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def brute_budgets(leaves, fraction, epochs):
    weight = lambda level, name: WEIGHTS[level].get(name, 1.0)
    cap = {k: epochs * t * (1 if weight("domain", k[0]) * weight("lang", k[1]) * weight("source", k[2]) else 0) for k, t in leaves.items()}
    out = {}

    def down(prefix, budget):
        level = len(prefix)
        if level == 3:
            out[prefix] = int(budget + 1e-6)
            return
        names = {k[level] for k in leaves if k[:level] == prefix}
        kids = {n: (sum(c for k, c in cap.items() if k[: level + 1] == (*prefix, n)), max(1e-12, weight(("domain", "lang", "source")[level], n))) for n in names}
        for n, b in fill(kids, int(budget + 1e-6)).items():
            down((*prefix, n), b)

    down((), fraction * sum(leaves.values()))
    return out


@pytest.mark.parametrize("fraction", [0.1, 0.6, 1.3, 5.0])
def test_budgets_match_brute_force(spark, fraction):
    rng = random.Random(3)
    leaves = {(d, g, s): rng.randint(1, 5000) for d in "abc" for g in ("en", "de", "xx") for s in ("s1", "s2", "s3") if rng.random() < 0.8}
    frame = spark.createDataFrame([(*k, t) for k, t in leaves.items()], [*LEAF, "tokens"])
    got = {tuple(r[c] for c in LEAF): r.budget for r in leaf_budgets(frame, weight_table(spark, WEIGHTS), fraction, 2).collect()}
    want = brute_budgets(leaves, fraction, 2)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) <= 3 for k in want), (got, want)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*values):
    """Spark's xxhash64 over ints and longs: each value's hash seeds the next; 42 is the first seed."""
    seed = 42
    for value, size in values:
        seed = xxhash.xxh64_intdigest(int(value).to_bytes(size, "little", signed=True), seed=seed)
    return signed(seed)


def test_prefix_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = take_counts(docs, weights=weight_table(spark, {"lang": {"en": 4.0}}), fraction=0.7).collect()
    leaves = collections.defaultdict(list)
    for r in got:
        leaves[tuple(r[c] for c in LEAF)].append(r)
    totals = {k: sum(r.n_tokens for r in v) for k, v in leaves.items()}
    frame = spark.createDataFrame([(*k, t) for k, t in totals.items() if t], [*LEAF, "tokens"])
    budgets = {tuple(r[c] for c in LEAF): r.budget for r in leaf_budgets(frame, weight_table(spark, {"lang": {"en": 4.0}}), 0.7, 2).collect()}
    assert sum(budgets.values()) == pytest.approx(0.7 * sum(totals.values()), rel=0.01)
    for leaf, rows in leaves.items():
        if leaf not in budgets:
            assert all(r.taken == 0 for r in rows)
            continue
        epochs, rest = divmod(int(budgets[leaf]), totals[leaf])
        order = sorted(rows, key=lambda r: ((spark_hash((17, 4), (epochs, 8), (r.doc_id, 8)) % (1 << 64)) >> 12, r.doc_id))
        used, open_ = 0, True
        for r in order:
            used += r.n_tokens
            open_ = open_ and used <= rest
            assert r.taken == (epochs + open_ if r.n_tokens else 0), (leaf, r.doc_id)


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = documents(spark, [(i, prose(i, 50), "en", "big") for i in range(30)] + [(100, prose(100, 50), "de", "small")])
    mixed = mix(docs, weights=weight_table(spark, {"lang": {"de": 50.0}}), fraction=0.5, domain=F.lit("d"))
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(r.doc_id == 100 for r in rows) == 2 and {r.taken for r in rows} == {"t"}


def test_awkward_rows(spark):
    got = take_counts(awkward(spark), fraction=1.0, max_epochs=1).collect()
    assert len(got) == 12 and all(r.taken == (1 if r.n_tokens else 0) for r in got)
    assert {r.leaf_source for r in got if r.doc_id == 5} == {"unknown"}
    assert take_counts(documents(spark, [])).count() == 0
    assert mix(documents(spark, [])).count() == 0
    assert take_counts(documents(spark, [(1, None)])).first().taken == 0
