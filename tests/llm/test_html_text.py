import random
import time

import pytest

from feedspan.llm.html_text import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy this</div>{article}<aside><p>Side text that is rather long, long enough to look like content.</p></aside>
<form><label>Mail</label><input name="q"><button>Go</button></form>
<section id="comments"><article class="comment"><p>A reader's comment of quite some length, as readers write them.</p></article></section>
<footer>&copy; 2024</footer></body></html>"""
ARTICLE = "<article><h1>Head &amp; line</h1><p>First  paragraph\n with <b>bold</b>&nbsp;text &lt;3.<p>Be.</p><ul><li>One</li><li>Two</ul><p>Last &#x41;&#66;.</p></article>"
WANT = "Head & line\nFirst paragraph with bold text <3.\nBe.\nOne\nTwo\nLast AB."


def test_surroundings_go_and_short_blocks_stay():
    assert main_text(PAGE.format(article=ARTICLE)) == WANT


def test_article_headline_in_its_header():
    page = PAGE.format(article="<article><header><h1>Head</h1><p class=byline>By me</p></header><p>Body text here, long enough.</p></article>")
    assert main_text(page) == "Head\nBody text here, long enough."


def test_pages_without_article_elements():
    text = " ".join(["word"] * 80)
    links = "".join(f"<a href='/{i}'>link {i}</a> " for i in range(30))
    page = f"<body><div>{links}</div><div><p>{text}</p><p>Short.</p><p>{text}</p></div></body>"
    assert main_text(page) == f"{text}\nShort.\n{text}"


def test_broken_markup_never_raises():
    whole = PAGE.format(article=ARTICLE)
    for cut in range(0, len(whole), 7):
        main_text(whole[:cut])
    rng = random.Random(4)
    for _ in range(300):
        main_text("".join(rng.choice(["<", ">", "!", "[", "--", "p", "/", "&", "<![", "<!x", "<?", "div", " ", '"', "#", ";"]) for _ in range(60)))


def test_given_pages_hold_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text
        heading = html[r.page_id].split("<h1>")[1].split("</h1>")[0]
        assert "&" in heading or r.text.startswith(" ".join(heading.split()))


def test_awkward_rows(spark):
    rows = [(1, "u", None, 7), (2, None, "", 7), (None, "u", "<nav>x</nav>", 7), (3, "u", "plain", 7), (3, "u", "plain", 7),
            (4, "u", "<p>" + "a b " * 200_000, 7), (5, "u", "<br>" * 50_000, 7)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract_pages(frame).collect()
    assert [r.text if r.n_chars < 100 else r.n_chars for r in got] == ["", "", "", "plain", "plain", 799_999, ""]
    assert extract_pages(frame.limit(0)).count() == 0


TEXT = " ".join(["word"] * 60)


def test_wrappers_named_after_what_is_beside():
    for name in ("content has-sidebar", "no-sidebar", "with-comments", "page-header-fixed", "comments-open"):
        page = f"<body><div class='{name}'><h1>Head</h1><p>{TEXT}</p><div class=comments><p>{TEXT} {TEXT} {TEXT}</p></div></div></body>"
        assert main_text(page) == f"Head\n{TEXT}", name
    assert main_text(f"<body><article><p>{TEXT}</p></article><div class=cookie-notice><p>{TEXT} {TEXT}</p></div></body>") == TEXT


def test_head_without_end():
    assert main_text(f"<html><head><title>x</title><body><p>{TEXT}</p></body></html>") == TEXT
    assert main_text(f"<head><title>x</title><p>{TEXT}</p>") == TEXT


def test_page_inside_a_form():
    page = f"<body><form id=aspnet><nav>Menu</nav><p>{TEXT}</p><select><option>1</select></form></body>"
    assert main_text(page) == TEXT
    assert main_text(f"<body><p>{TEXT}</p><form><p>Mail</p></form></body>") == TEXT


@pytest.mark.parametrize("unit", [
    "<a ", "<a b='", "<!-- x>", "<b></i>", "<b>", "<b><dd></dd>", "</p>", "<li><b>", "<td><div>", "<header><h1>", "&amp", "<p>x<b>",
])
def test_broken_pages_take_linear_time(unit):
    def spent(n):
        start = time.perf_counter()
        main_text("<body><p>" + unit * (n // len(unit)))
        return time.perf_counter() - start

    once = min(spent(300_000) for _ in range(2))
    assert min(spent(600_000) for _ in range(2)) < max(2.5 * once, 0.7)


def test_many_stray_end_tags():
    assert main_text("<p>" + "<b>" * 100_000 + "x" + "</i>" * 100_000) == "x"
