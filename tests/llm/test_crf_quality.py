import itertools
import zlib

import numpy as np

from feedspan.llm.crf_quality import keep_good, line_features, marginals, quality_scores, with_neighbours

from helpers import awkward, documents, prose


def brute_marginals(emit, trans):
    weights = {}
    for states in itertools.product((0, 1), repeat=len(emit)):
        w = sum(e for e, s in zip(emit, states, strict=True) if s) + sum(trans[a, b] for a, b in zip(states, states[1:]))
        weights[states] = np.exp(w)
    total = sum(weights.values())
    post = [sum(w for s, w in weights.items() if s[t]) / total for t in range(len(emit))]
    pairs = np.zeros((2, 2))
    for s, w in weights.items():
        for a, b in zip(s, s[1:]):
            pairs[a, b] += w / total
    return post, pairs, np.log(total)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 6, 3, 6, 2])
    emit, trans = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    post, pairs, log_z = marginals(emit, lengths, trans)
    parts = [brute_marginals(e, trans) for e in np.split(emit, np.cumsum(lengths)[:-1])]
    assert np.allclose(post, np.concatenate([p for p, *_ in parts]))
    assert np.allclose(pairs, sum(p for _, p, _ in parts))
    assert np.isclose(log_z, sum(z for *_, z in parts))


def test_features_see_neighbours():
    base, size = line_features("A line.\n\nSHOUT!! SHOUT!!\nlast one")
    full = with_neighbours(base)
    k = base.shape[1]
    assert len(size) == 3 and (full[1, k : 2 * k] == base[0]).all() and (full[1, 2 * k : 3 * k] == base[2]).all()
    assert not full[0, k : 2 * k].any() and not full[2, 2 * k : 3 * k].any()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    got = quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)


def test_awkward_rows(spark):
    good = [(100 + i, prose(i, 60) + ".") for i in range(40)]
    bad = [(200 + i, "\n".join(f"{w.upper()}!! {w.upper()}!!" for w in prose(i, 20).split())) for i in range(40)]
    docs = awkward(spark).unionByName(documents(spark, good + bad))
    marks = labels(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(100, 1, 0), (None, 1, 0), (999, 0, 1), (101, None, None)])
    got = quality_scores(docs, marks).collect()
    assert len(got) == 92 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r.predicted for r in got}
    assert all(by_id[i] == 1 for i, _ in good) and all(by_id[i] == 0 for i, _ in bad)
    kept = keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 200").count() == 0
    assert quality_scores(documents(spark, []), marks).count() == 0
    assert {r.score for r in quality_scores(docs, labels(spark, [])).collect()} == {0.5}
