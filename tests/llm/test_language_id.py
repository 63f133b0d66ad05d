import math
import zlib

import numpy as np

from feedspan.llm.language_id import DEPTH, PAD, build_model, code_lengths, grams, language_id, plain_bytes, predict

from helpers import awkward, documents

TEXTS = {"de": "der hund und die katze über straße " * 4, "en": "the dog and the cat over there " * 4}


def model_of(texts):
    langs, parts = sorted(texts), []
    for i, lang in enumerate(langs):
        data = np.frombuffer(PAD + plain_bytes(texts[lang]), dtype=np.uint8)
        for length in range(1, DEPTH + 1):
            keys, n = np.unique(grams(data, length), return_counts=True)
            parts.append((np.full(len(keys), i), np.full(len(keys), length), keys, n))
    return build_model(langs, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def brute_bits(training, text):
    """Code length by walking down the contexts of each byte."""
    data, out = PAD + plain_bytes(training), 0.0
    count = {}
    for length in range(1, DEPTH + 1):
        for i in range(len(data) - length + 1):
            following = count.setdefault(data[i : i + length - 1], {})
            following[data[i + length - 1]] = following.get(data[i + length - 1], 0) + 1
    # Contexts of each length were counted where a byte follows; the empty one holds all bytes.
    coded = PAD + plain_bytes(text)
    for i in range(DEPTH - 1, len(coded)):
        for k in range(DEPTH - 1, -1, -1):
            following = count.get(coded[i - k : i])
            if not following:
                continue
            total = sum(following.values()) + len(following)
            if coded[i] in following:
                out -= math.log2(following[coded[i]] / total)
                break
            out -= math.log2(len(following) / total)
        else:
            out += 8
    return out


def test_code_lengths_match_a_context_walk():
    model = model_of(TEXTS)
    for text in ("der hund", "the zebra quotes 7 ñandúes", "Ωmega", "x"):
        data = np.frombuffer(PAD + plain_bytes(text), dtype=np.uint8)
        got = code_lengths(data, model).sum(0)
        want = [brute_bits(TEXTS[lang], text) for lang in ("de", "en")]
        assert np.allclose(got, want, rtol=1e-4), (text, got, want)


def test_texts_of_a_batch_do_not_touch():
    model = model_of(TEXTS)
    texts = ["the cat", "die katze", None, "", "123 !?", "over the straße " * 3, "dog"]
    together = predict(texts, model)
    apart = [predict([t], model) for t in texts]
    assert together[0] == [p[0] for p, _ in apart]
    assert np.allclose(together[1], [s[0] for _, s in apart], atol=1e-4)
    assert together[0][2:5] == ["und"] * 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)


def test_awkward_rows(spark):
    got = language_id(awkward(spark)).collect()
    assert len(got) == 12
    assert all(r.lang_pred in ("en", "und") for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4, 8, None}
    assert language_id(documents(spark, [])).count() == 0
    alone = language_id(documents(spark, [(1, "abc", None, None)])).first()
    assert (alone.lang_pred, alone.score) == ("und", 0.0)
