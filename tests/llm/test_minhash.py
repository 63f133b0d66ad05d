import collections
import re

import numpy as np
import pytest

from feedspan.llm.components import components
from feedspan.sources.storage import staged
from feedspan.llm.minhash import SIZE, copies, drop_duplicates, duplicate_classes, overlap, shingles, sign

from helpers import awkward, documents, prose


def bag(text):
    w = re.sub(r"[^\w]+", " ", (text or "").lower()).split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(texts, least=0.8):
    """Least id of each class, by all pairs."""
    bags = {i: bag(t) for i, t in texts.items()}
    ids, parent = sorted(bags), {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(set)
    for i in ids:
        for s in bags[i] or ():
            holders[s].add(i)
    for i in ids:
        for j in sorted({j for s in bags[i] or () for j in holders[s] if j < i}):
            both = sum((bags[i] & bags[j]).values())
            if both >= least * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_signatures_estimate_without_bias():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a, b = (rng.integers(0, 2**63, 260).astype(np.uint64) for _ in range(2))
        b[:200] = a[:200]
        ca, cb = rng.integers(1, 9, 260), rng.integers(1, 9, 260)
        least = np.minimum(ca[:200], cb[:200]).sum()
        true = least / (ca.sum() + cb.sum() - least)
        s = sign(np.repeat([0, 1], 260), np.concatenate([a, b]), np.concatenate([ca, cb]), 2)
        errors.append((s[0] == s[1]).mean() - true)
        ia, ib = np.argsort(a), np.argsort(b)
        assert overlap(copies(a[ia], ca[ia]), copies(b[ib], cb[ib])) == pytest.approx(true)
    assert abs(np.mean(errors)) < 3 * 0.5 / np.sqrt(SIZE * 40)


def test_shingles_count_repeats():
    hashes, counts = shingles("a b c d e a b c d e")
    assert len(hashes) == 5 and sorted(counts) == [1, 1, 1, 1, 2]
    assert len(shingles("a b")[0]) == 1 and len(shingles("")[0]) == 0


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_classes({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.component_id for r in duplicate_classes(docs).collect()}
    assert got == want


def test_chains_stars_and_multiplicity(spark):
    base = prose(1, 200).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 12):  # each differs from the one before, the ends from each other
        rows.append((k, " ".join(base[: 200 - 6 * k] + prose(50, 6 * k).split())))
    rows += [(100 + k, " ".join(base[:190] + [f"w{k}"] + base[191:])) for k in range(60)]
    block = prose(9, 12)
    rows += [(300, " ".join([block] * 3)), (301, " ".join([block] * 30))]  # same shingles, other counts
    got = {r.doc_id: r.component_id for r in duplicate_classes(documents(spark, rows)).collect()}
    assert got == brute_classes(dict(rows))
    assert got[300] != got[301]


def test_passage_shared_by_many_is_no_duplicate(spark):
    shared = prose(77, 50)
    rows = [(i, f"{prose(i, 90)} {shared} {prose(i + 1000, 60)}") for i in range(150)]
    assert all(r.kept for r in duplicate_classes(documents(spark, rows)).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = duplicate_classes(docs).collect()
    assert len(got) == 12
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    rows = collections.Counter(r.doc_id for r in kept.collect())
    assert rows == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 2}
    assert duplicate_classes(documents(spark, [])).count() == 0 and drop_duplicates(documents(spark, [])).count() == 0
    assert duplicate_classes(documents(spark, [(1, None)])).first().kept
    # Copies of one text under a null and a known id.
    pair = documents(spark, [(None, prose(1, 50)), (4, prose(1, 50))])
    assert [r.doc_id for r in drop_duplicates(pair).collect()] == [4]
    # One id with two texts: two documents.
    assert drop_duplicates(documents(spark, [(1, prose(1, 50)), (1, prose(2, 50))])).count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 150)}, 200: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_end_when_only_stars_are_left(spark, monkeypatch):
    """Stars need no round of contraction, and a chain of three none to find out that it is done."""
    written = []

    def counted(df, purpose):
        written.append(purpose)
        return staged(df, purpose)

    monkeypatch.setattr("feedspan.llm.components.staged", counted)
    stars = spark.createDataFrame([(1, 5), (9, 1), (2, 3), (4, 4)], "u long, v long")
    got = {r.node: r.root for r in components(stars).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 2: 2, 3: 2, 4: 4} and len(written) == 1
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u long, v long")
    written.clear()
    assert {r.node: r.root for r in components(chain).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert (len(written) - 1) % 4 == 0 and len(written) <= 9
