import hashlib
import json
import random
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedspan.llm import bpe as module
from feedspan.llm.bpe import VOCABULARY, ByteBpe, blocks, bpe_decode, bpe_digests, bpe_encode, younger_characters

from helpers import awkward, documents

DEFINITION = open(VOCABULARY, "rb").read()
YOUNGER = younger_characters(DEFINITION)
LIBRARY = Tokenizer.from_file(VOCABULARY)
OURS = ByteBpe(DEFINITION, YOUNGER)


def lists(bpe, texts):
    ids, counts = bpe.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def texts_of(lists_of_ids):
    flat = np.array([i for x in lists_of_ids for i in x], np.int32)
    return OURS.decode(flat, np.array([len(x) for x in lists_of_ids], np.int64)).to_pylist()


def same(texts):
    got = lists(OURS, texts)
    assert got == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert texts_of(got) == [LIBRARY.decode(x, skip_special_tokens=False) for x in got] == texts


def test_corpus_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    same([r.text or "" for r in rows])


def test_odd_texts():
    same([
        "", " ", "\n", "  a  b\n\n c ", "'s 'S we'll don't", "a" * 3000, " " * 700 + "x", "\n" * 99, "\x00\x1c\x1f\x85 ",
        "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "é漢字ß͸ 😀👩‍👩‍👧", "１２½Ⅷ", YOUNGER[:40], "a" + YOUNGER[0] + "1",
    ])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("ab 's\n\té漢<|endoftext|>1" + YOUNGER[:3], max_size=80)), max_size=4))
def test_random_texts(texts):
    same(texts)


def test_character_classes():
    """A sample of all characters, and every tenth of the younger ones, splits as in the library."""
    rnd = random.Random(1)
    some = [chr(c) for c in rnd.sample([c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000], 20_000)]
    for c in [*some, *YOUNGER[::10]]:
        text = f"a{c}1{c}!{c}{c}b"
        assert OURS.split(text) == [text[x:y] for _, (x, y) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))
    assert all(unicodedata.category(c) == "Cn" for c in YOUNGER)


def test_index_agrees_with_one_word_at_a_time():
    """All words at once, or each alone by repeated search for its lowest rank."""
    rank = {(a, b): r for r, (a, b, _) in enumerate(OURS.rules)}

    def slow(word):
        ids = [OURS.byte_ids[x] for x in word]
        while True:
            found = min(((rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
            if found is None:
                return ids
            ids[found[1] : found[1] + 2] = [OURS.rules[found[0]][2]]

    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abent hers") for _ in range(rnd.randrange(1, 40))) for _ in range(400)] + [b"a" * k for k in range(1, 40)]
    assert [np.frombuffer(x, np.int32).tolist() for x in OURS.merge(words)] == [slow(w) for w in words]


def test_ids_that_are_not_a_text():
    rnd = random.Random(4)
    ids = [[rnd.randrange(len(OURS.pieces)) for _ in range(rnd.randrange(20))] for _ in range(300)]
    assert texts_of(ids) == [LIBRARY.decode(x, skip_special_tokens=False) for x in ids]
    assert texts_of([]) == [] and texts_of([[], [50256], []]) == ["", "<|endoftext|>", ""]


def test_forgetting_and_long_words(monkeypatch):
    monkeypatch.setattr(module, "KEPT_WORDS", 3)
    monkeypatch.setattr(module, "LONG_WORD", 4)
    fresh = ByteBpe(DEFINITION, YOUNGER)
    texts = ["some longer words here", "and here some others", "words again and again " * 30]
    for _ in range(3):
        assert lists(fresh, texts) == lists(OURS, texts)
    assert all(len(w) <= 4 for w in fresh.known)


def test_small_runs_of_the_index(monkeypatch):
    texts = ["words of many kinds <|endoftext|> and " + "x" * 500, "others here 12 345"]
    want = lists(OURS, texts)
    monkeypatch.setattr(module, "INDEXED", 3)
    assert lists(ByteBpe(DEFINITION, YOUNGER), texts) == want


def test_other_kinds_of_vocabulary_are_refused():
    spec = json.loads(DEFINITION)
    spec["model"]["ignore_merges"] = True
    with pytest.raises(ValueError, match="plain"):
        ByteBpe(json.dumps(spec).encode())
    spec = json.loads(DEFINITION)
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError, match="merge"):
        ByteBpe(json.dumps(spec).encode())


def test_blocks_hold_every_text():
    texts = pa.array(["abc", None, "", "d" * 10, "e", "ff", "é"])
    assert list(blocks(texts, 4)) == [(0, 3), (3, 4), (4, 6), (6, 7)]
    assert list(blocks(pa.array([[1, 2], None, [3]], pa.list_(pa.int32())), 2)) == [(0, 2), (2, 3)]
    assert list(blocks(texts.slice(0, 0), 4)) == []


def test_special_strings_as_text(spark):
    docs = documents(spark, [(1, "x<|endoftext|>")])
    assert bpe_encode(docs).first().ids[-1] == 50256
    plain = bpe_encode(docs, specials=False).first().ids
    assert 50256 not in plain and texts_of([plain]) == ["x<|endoftext|>"]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = {(r.doc_id, r.decoded) for r in bpe_decode(bpe_encode(docs)).collect()}
    assert rows == {(r.doc_id, r.text or "") for r in docs.collect()}
    digests = bpe_digests(docs).collect()
    assert len(digests) == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in digests if r.doc_id in (2, 3)} == {(0, empty, empty)}
    five = next(r for r in digests if r.doc_id == 5)
    ids = LIBRARY.encode(next(r.text for r in docs.collect() if r.doc_id == 5), add_special_tokens=False).ids
    assert five.n_tokens == len(ids) and five.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe_digests(docs.limit(0)).count() == 0
