import hashlib
import random

import pytest

from feedspan.llm import fill_in_middle as module
from feedspan.llm.fill_in_middle import arrange, fill_in_middle, fim_digests, restore, restore_texts, rotate

from helpers import awkward, documents

MARKS = (b"<P>", b"<S>", b"<M>")
WRITTEN = {
    "plain": lambda p, m, s: p + m + s,
    "psm": lambda p, m, s: f"<P>{p}<S>{s}<M>{m}",
    "spm": lambda p, m, s: f"<S>{s}<P>{p}<M>{m}",
}


def expected(doc_id, text):
    """Form and output of a text, straight from the definition."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
    cut = (None, None) if plain else (lo, hi - lo)
    return (doc_id, len(text), form, *cut, WRITTEN[form](text[:lo], text[lo:hi], text[hi:]))


@pytest.mark.parametrize("piece", [1, 3, 1 << 16])
def test_rotation_exchanges_segments(monkeypatch, piece):
    monkeypatch.setattr(module, "PIECE", piece)
    raw = bytes(range(23))
    for a in range(0, 24, 3):
        for cut in range(a, 24):
            for b in range(cut, 24):
                buf = bytearray(raw)
                rotate(buf, a, cut, b)
                assert bytes(buf) == raw[:a] + raw[cut:b] + raw[a:cut] + raw[b:]


def test_every_cut_and_form_round_trips():
    for text in ("", "a", "abc", "añ漢😀é", "<P", "S><", "a<b>\0c", "\n<<P\n"):
        for lo in range(len(text) + 1):
            for hi in range(lo, len(text) + 1):
                for form, write in WRITTEN.items():
                    out = arrange(text.encode(), lo, hi, form, MARKS)
                    assert out.decode() == write(text[:lo], text[lo:hi], text[hi:])
                    assert restore(bytes(out), form, MARKS).decode() == text


def test_rows_by_definition(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab ñ漢😀<PSM>\n") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += ["with <M> inside", "<P>", "<S>x", None, "", "x" * 300_000, "漢" * 100_000]
    docs = documents(spark, [*enumerate(texts), (None, "no id"), (5, texts[5])])
    got = [tuple(r) for r in restore_texts(fill_in_middle(docs)).collect()]
    want = [(*expected(r.doc_id, r.text), r.text or "") for r in docs.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_and_shares(spark):
    docs = documents(spark, [(i, f"text {i} <P> here") for i in range(50)])
    marks = ("[pre]", "[suf]", "[mid]")
    rows = restore_texts(fill_in_middle(docs, seed=9, plain=0, spm=100, marks=marks), marks).collect()
    assert all(r.form == "spm" and r.output.startswith("[suf]") and r.restored == f"text {r.doc_id} <P> here" for r in rows)


def test_awkward_rows(spark):
    rows = fim_digests(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2][1:] == by_id[3][1:] == (0, "plain", None, None, empty, empty)
    long = next(r.text for r in awkward(spark).collect() if r.doc_id == 7)
    assert by_id[7].restored_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert len({tuple(r) for r in rows if r.doc_id == 6}) == 1
    assert fim_digests(awkward(spark).limit(0)).count() == 0
