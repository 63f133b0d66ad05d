import collections
import re

from feedspan.llm.quality_rules import count_text, quality_rules

from helpers import awkward, documents, prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, dup, len(covered))


def test_counts_match_brute_force():
    texts = [None, "", " ", "a", "a a a a", "a b c a b c", "x\ny\nx\n\n\n", "é ü #|<", "a\x0bb\x0cc\rd", "a b c " * 3,
             prose(1, 500), "one two three " * 50, "\x1c\x85 a"]
    assert [count_text(t) for t in texts] == [brute(t) for t in texts]


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules(docs).collect():
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (*b[:3], *b[4:])
        assert r.base_failed == (b[0] < 50 or 100 * b[5] > 50 * b[0])
        assert not (r.base_failed and r.kept)


def test_fences_follow_the_group(spark):
    """A source full of symbols keeps its texts; the same text is an outlier in a plain source."""
    marked = lambda i: " ".join(w + " #" for w in prose(i, 60).split())
    rows = [(i, prose(i, 100), "en", "plain") for i in range(120)]
    rows += [(1000 + i, marked(i), "en", "code") for i in range(120)]
    rows += [(5000, marked(7), "en", "plain"), (5001, marked(8), "en", "code")]
    got = {r.doc_id: r for r in quality_rules(documents(spark, rows)).collect()}
    assert got[5001].kept and all(got[i].kept for i in range(120))
    assert not got[5000].kept and got[5000].rule == "symbols_high"


def test_repeats_below_the_base_limit(spark):
    """Planted repeats that the base rules pass: lines copied often, and passages found twice."""
    rows = [(i, "\n".join(prose(31 * i + k, 20) for k in range(40))) for i in range(300)]
    line = prose(9, 20).split()
    # Word pairs change from line to line, so no window of three words repeats, but short lines do.
    copied = "\n".join(["a b"] * 300 + [prose(7000 + k, 30) for k in range(40)])
    passage = prose(11, 900)
    doubled = " ".join([passage[: len(passage) * 2 // 10], prose(12, 900), passage[: len(passage) * 2 // 10], *line])
    rows += [(1000, copied), (1001, doubled)]
    got = {r.doc_id: r for r in quality_rules(documents(spark, rows)).collect()}
    assert all(got[i].kept for i in range(300))
    assert not got[1000].base_failed and got[1000].rule == "dup_lines_high"
    assert not got[1001].base_failed and got[1001].rule == "repeats_high"


def test_one_symbol_is_no_outlier(spark):
    """Where no text has symbols, a few stay; a text full of them goes."""
    rows = [(i, prose(i, 80)) for i in range(120)]
    rows += [(500, prose(500, 80) + " # &"), (501, prose(501, 80) + " #" * 30)]
    got = {r.doc_id: r for r in quality_rules(documents(spark, rows)).collect()}
    assert got[500].kept and got[501].rule == "symbols_high"


def test_labelled_good_texts_stay_and_bad_ones_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert all(good) and not any(bad) and len(good) > 200 and len(bad) > 10


def test_awkward_rows(spark):
    got = quality_rules(awkward(spark)).collect()
    assert len(got) == 12
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert sum(r.doc_id == 6 for r in got) == 2
    assert quality_rules(documents(spark, [])).count() == 0
    assert quality_rules(documents(spark, [(1, None)])).first().base_failed
