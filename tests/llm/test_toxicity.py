import random

import pytest

from feedspan.llm.toxicity import EXACT, FUZZY, STEM, Scorer, TermMachine, allowed_edits, drop_toxic, pick_terms, toxicity_scores

from helpers import awkward, documents, prose


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_machine_matches_edit_distance():
    rng = random.Random(2)
    terms = ["scum", "idiot", "moron", "worthless", "abacab", "disgusting"]
    machine = TermMachine(terms, [])
    words = list(terms)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            w[k : k + (kind > 0)] = [] if kind == 1 else [rng.choice("abcdiomnrst")]
        words.append("".join(w))
    for w in words:
        want = EXACT if w in terms else FUZZY if any(edits(w, t) <= allowed_edits(t) for t in terms) else -1
        assert machine.match(w) == want, w


def test_stems_and_exceptions():
    machine = TermMachine(["closer"], ["lowe"], frozenset({"closet"}))
    assert machine.match("loweisch") == STEM and machine.match("low") == -1
    assert machine.match("closex") == FUZZY and machine.match("closet") == -1


def test_terms_and_stems_are_learned():
    words = [("idiot", 40, 0), ("the", 90, 900), ("rare", 2, 0), *((f"lowe{x}", 9, 0) for x in ("a", "b", "c", "d")), ("lower", 0, 5), ("bravo", 3, 2)]
    model = pick_terms(words, 100, 1000)
    assert model["terms"] == ["idiot", "lowea", "loweb", "lowec", "lowed"] and model["stems"] == []
    assert pick_terms([w for w in words if w[0] != "lower"], 100, 1000)["stems"] == ["lowe"]


def test_quotation_weighs_less_than_abuse():
    scorer = Scorer({"terms": ["idiot"], "stems": [], "exceptions": frozenset()})
    weight = lambda text: scorer.features(text)[3]
    assert weight('Critics wrote the word "idiot" in that old book of theirs') < 0.3
    assert weight("go away you idiot and never come back here") == 1.0
    assert weight("a plain text") == 0.0


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).toPandas()
    truth = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert len(got) == 10_000
    assert held[held.predicted == 1].toxic.mean() >= 0.9 and held[held.toxic == 1].predicted.mean() >= 0.9


@pytest.fixture(scope="module")
def corpus(spark):
    clean = [(i, prose(i, 80)) for i in range(100, 180)]
    toxic = [(i, f"{prose(i, 40)} you idiot {prose(i + 1, 20)} worthless {prose(i + 2, 20)}") for i in range(300, 340)]
    return clean, toxic


def test_awkward_rows(spark, corpus):
    clean, toxic = corpus
    odd = [(500, "you worthles idiott " + prose(9, 30)), (501, prose(501, 50))]
    docs = awkward(spark).unionByName(documents(spark, clean + toxic + odd))
    marks = labels(spark, [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic] + [(300, 1, 1), (None, 0, 1), (9999, 0, 1)])
    got = toxicity_scores(docs, marks).collect()
    assert len(got) == 134 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    flagged = {r.doc_id for r in got if r.predicted}
    assert flagged == {i for i, _ in toxic} | {500}
    kept = drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 134 - 41
    assert toxicity_scores(documents(spark, []), marks).count() == 0
    assert {r.score for r in toxicity_scores(docs, labels(spark, [])).collect()} == {0.0}
