import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from feedspan.llm import alignment as module
from feedspan.llm.alignment import PIECES, Aligner, PieceTokenizer, WordBpe, align_ids, align_tokens, alignment_digests, coalesce
from feedspan.llm.bpe import VOCABULARY, ByteBpe, byte_alphabet, younger_characters

from helpers import awkward, documents

A = Tokenizer.from_file(VOCABULARY)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
BYTE_OF = byte_alphabet()


def token_bytes(text):
    a = [(i, bytes(BYTE_OF[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def groups_of(text):
    """Groups of (A ids, B ids), by the byte offsets at which both sides end a token."""
    if not text:
        return []
    a, b = token_bytes(text)
    if any(b"".join(x for _, x in side) != f" {text}".encode() for side in (a, b)):
        return []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    cuts = set(ends[0]) & set(ends[1])
    out = []
    for side, end in zip((a, b), ends):
        lists = [[]]
        for (i, _), e in zip(side, end):
            lists[-1].append(i)
            if e in cuts:
                lists.append([])
        out.append(lists[:-1])
    return list(zip(*out, strict=True))


def brute_force(rows):
    """Result rows of (doc_id, text), from lists of all links."""
    groups = [groups_of(t) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = Counter(p for ls in links for p in set(ls))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    for (doc_id, _), g, ls in zip(rows, groups, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls),
               sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls),
               hashlib.sha256(written.encode()).hexdigest() if g else "")


def texts():
    rnd = random.Random(8)
    some = ["".join(rnd.choice(["the ", "Haus", " maison", "é", "漢", "😀", "  ", "\n", "=", "x", "9", "un", "able", "\t"])
                    for _ in range(rnd.randrange(1, 60))) for _ in range(120)]
    return some + [None, "", " ", "\n", "a ▁ b", "<|endoftext|> and <s> x</s> <unk>", "\x00\x01", "=" * 900, " " * 500 + "x" + "-" * 333,
                   "ﬁ ①", "the the the", "the the the"]


@pytest.mark.parametrize("size", [(500, 400_000), (7, 400_000), (500, 50)])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(module, "BLOCK_ROWS", size[0])
    monkeypatch.setattr(module, "BLOCK_TOKENS", size[1])
    rows = list(enumerate(texts()))
    got = [tuple(r) for r in alignment_digests(documents(spark, rows).repartition(3)).collect()]
    assert sorted(got) == sorted(brute_force(rows))


def test_corpus_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in alignment_digests(docs).collect()]
    assert sorted(got) == sorted(brute_force(rows))


def test_aligned_tokens_are_spans_of_the_text(spark):
    for r in align_tokens(documents(spark, list(enumerate(texts())))).collect():
        want = groups_of(texts()[r.doc_id])
        assert [len(a) for a, _ in want] == r.group_a and [len(b) for _, b in want] == r.group_b
        assert [i for a, _ in want for i in a] == r.a and [i for _, b in want for i in b] == r.b
        assert sum(r.group_bytes) == (len(f" {texts()[r.doc_id]}".encode()) if want else 0)


def test_coalesced_intervals():
    start, end = np.array([0, 3, 5, 0, 4]), np.array([3, 5, 6, 4, 6])
    order, group = coalesce(start, end)
    assert order.tolist() == [0, 3, 1, 4, 2] and group.tolist() == [0, 0, 0, 0, 0]
    order, group = coalesce(np.array([0, 2, 0, 2, 3]), np.array([2, 4, 2, 3, 4]))
    assert group.tolist() == [0, 0, 1, 1, 1]


def test_texts_never_share_a_group():
    size = np.array([1, 2])
    n_groups, n_a, n_b, n_bytes = align_ids(
        np.array([0, 1, 1]), np.array([2, 0, 1]), np.array([1, 0, 0, 0]), size, size)
    assert n_groups.tolist() == [1, 0, 1] and n_a.tolist() == [2, 1] and n_b.tolist() == [2, 2] and n_bytes.tolist() == [3, 2]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in alignment_digests(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)
    assert alignment_digests(docs.limit(0)).count() == 0
    nothing = documents(spark, [(1, None), (2, "")])
    assert [tuple(r)[1:] for r in alignment_digests(nothing).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pieces_word_by_word_equal_whole_texts():
    """Words are encoded once and remembered; runs of spaces, U+2581 and words too long to be remembered stay exact."""
    side = PieceTokenizer(open(PIECES, "rb").read())
    assert side.by_word
    rng, parts = random.Random(3), [*" 　\n▁aé́ß1<>/😀\x00", "   ", "th", "ing", " ", "x" * 201]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "a ", "▁", "▁ ", " ▁x", "a▁ b", " " * 300, "y" * 500 + " " + "y" * 500]
    for lo in range(0, len(texts), 100):
        block = texts[lo : lo + 100]
        ids, counts = side.encode(block)
        want = side.model.encode(block)
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert not any(len(w) > 200 for w in side.known) and side.known


def vocabulary():
    definition = open(VOCABULARY, "rb").read()
    return definition, younger_characters(definition)


def aligned_texts(aligner, block):
    """Groups of (A ids, B ids) of each text, by the aligner's units."""
    numbers, counts = aligner.numbers(block)
    x = aligner.aligned.take(numbers)
    a, b, n_a, n_b = (c.tolist() for c in (x.a, x.b, x.group_a, x.group_b))
    groups = [(a[i - p : i], b[j - q : j]) for p, q, i, j in zip(n_a, n_b, np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist())]
    out, upto = [], [0, *np.cumsum(x.n_groups).tolist()]
    for lo, n in zip(np.cumsum(counts) - counts, counts):
        out.append(groups[upto[lo] : upto[lo + n]])
    aligner.forget()
    return out


@pytest.mark.parametrize("kept", [100_000, 20, 0])
@pytest.mark.parametrize("by_word", [True, False])
def test_units_equal_whole_texts(monkeypatch, kept, by_word):
    """Units met again, forgotten, too long to be remembered or not what their tokens join to; white space of all kinds between them."""
    monkeypatch.setattr(module, "KEPT_WORDS", kept)
    aligner = Aligner(vocabulary(), open(PIECES, "rb").read())
    assert aligner.right.by_word
    aligner.right.by_word = by_word
    rng, parts = random.Random(4), [*"  \u3000\n\t\r\x1c\x85\u2028▁aé́ß1'</\ufeff😀\x00", "   ", "th", "'s", "ing", " the", "x" * 201, " \n "]
    some = [t or "" for t in texts()] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)]
    for lo in range(0, len(some), 60):
        block = some[lo : lo + 60]
        assert aligned_texts(aligner, block) == [[(a, b) for a, b in groups_of(t)] for t in block]
    assert not any(len(u) > 200 for u in aligner.known) and len(aligner.known) == len(aligner.aligned.n_a)


def test_repeated_words_are_aligned_once(monkeypatch):
    """The tokens that meet the sort grow with the distinct words, not with the texts."""
    met, whole = [], align_ids
    monkeypatch.setattr(module, "align_ids", lambda a, *rest: met.append(len(a)) or whole(a, *rest))
    text = "It was the best of times, it was the worst of times."
    aligner = Aligner(vocabulary(), open(PIECES, "rb").read())
    assert aligned_texts(aligner, [text] * 300) == [groups_of(text)] * 300
    assert aligned_texts(aligner, [text + " It was"] * 300) == [groups_of(text + " It was")] * 300
    assert 0 < sum(met) < 20


def test_rounds_equal_the_index_of_pairs():
    """The same tokens whichever way words are merged, at and around the length where the way changes."""
    rng, definition = random.Random(6), vocabulary()
    words = ["".join(rng.choices("etaoinshr =-é漢", k=rng.randint(1, 30))).encode() for _ in range(3000)]
    words += [c * n for c in (b"=", b" ", b"a", b"-", b"\xc3") for n in (1, 2, 3, 31, 63, 64, 65, 300)] + [bytes([i]) for i in range(256)]
    rng.shuffle(words)
    assert WordBpe(*definition).merge(words) == ByteBpe(*definition).merge(words)
    assert WordBpe(*definition).merge([]) == [] and WordBpe(*definition).merge([b"="]) == ByteBpe(*definition).merge([b"="])
