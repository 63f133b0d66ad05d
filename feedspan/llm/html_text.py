"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clusters.

The parser's events cut a page into lines, one per block element. Lines inside elements that
never hold article text (navigation, footers, forms, adverts, comments ...) are dropped at
once, but forms and what is only named like surroundings stay if they wrap most of the page's
text. Each other line has a ratio of text to tags; the ratios are smoothed with a Gaussian and
runs above a threshold are content regions. A container whose text lies mostly in regions is
content as a whole, with the containers inside it, so its short lines stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedspan.functions.html import BoundedParser

# Element names of HTML, and names that pages give to their surroundings.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside body div html main section".split())
NEVER = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video select option datalist "
    "textarea button input nav footer aside menu dialog search fieldset".split()
)
SURROUND = frozenset(
    "ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs byline-links comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus footer footnav form gdpr header hidden login masthead "
    "menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted "
    "promotion recommended related replies reply respond responses rss search share sharing sidebar sidenav signup "
    "skip-link social sponsor sponsored subscribe subscription tags toc toolbar topbar widget".split()
)
COMMENT = frozenset("comment comments reply replies response".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
IMPLIED_END = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Parts of a class that say the named thing is beside or missing: has-sidebar, no-sidebar, with-comments.
BESIDE = frozenset("has no not with without".split())
THREAD = COMMENT | frozenset("commentlist discussion disqus respond responses".split())
UNKNOWN, NAMED, THREADED, SURE = range(4)
NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def is_surrounding(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    if tag in NEVER:
        return SURE
    found = NAMED if tag == "form" else UNKNOWN
    for key, value in attrs:
        value = (value or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return SURE
        if key == "role" and value in ROLES and value != "form":
            return SURE
        if key == "style" and "display:none" in value.replace(" ", ""):
            return SURE
        if key in ("class", "id") and tag not in ("html", "body", "main"):
            # An article may well be about adverts or menus; only a comment is one by its class.
            names = COMMENT if tag == "article" else SURROUND
            for name in NAME.findall(value.replace("_", "-")):
                parts = name.split("-")
                if name in names or not (names.isdisjoint(parts) or not BESIDE.isdisjoint(parts)):
                    found = max(found, NAMED if THREAD.isdisjoint(parts) else THREADED)
    return found


class Lines(BoundedParser):
    """Collects (text, tags, container) for each block outside the surroundings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, int]] = []  # a line and its surrounding
        # Element, inside sure surroundings, container, surrounding, and the places of the last element
        # that ends a search for an implied end, and of the last block.
        self.stack: list[tuple[str, bool, int, int, int, int]] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of each name
        self.parts: list[str] = []
        self.tags = 0
        self.parents = [-1]  # of each container; -1 for what hangs on the page itself
        self.around = [0]  # the surrounding that each possible one stands in; 0 is none
        self.thread = [False]
        self.headed = [False]  # holds a headline, an article or a main part
        self.plain = [0]  # characters outside links and headlines

    def _where(self) -> tuple[str, bool, int, int, int, int]:
        return self.stack[-1] if self.stack else ("", False, 0, 0, -1, -1)

    def _open(self, *tags: str) -> int:
        """Place of the innermost open element of these names, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, self.tags, *self._where()[2:4]))
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        if tag == "body" or tag not in HEAD and self._where()[0] == "head":
            self._end_head()
        if tag in VOID:
            self.parts.append(" ")
            return
        ends = IMPLIED_END.get(tag)
        if ends:
            place = self._open(*ends)
            if place > self._where()[4]:
                self._cut(place)
        above, inside, container, around, stop, block = self._where()
        if tag in CONTAINER:
            self.parents.append(-1 if above in ("html", "body") else container)
            container = len(self.parents) - 1
        # A header names the page, but the headline in the header of an article belongs to it.
        header = tag == "header"
        kept = tag == "h1" and inside and self._open("header") >= 0 and self._open("article", "main") >= 0
        kind = SURE if header else is_surrounding(tag, attrs)
        if kind in (NAMED, THREADED) and not kept and not inside:
            self.around.append(around)
            self.thread.append(kind == THREADED)
            self.headed.append(False)
            self.plain.append(0)
            around = len(self.around) - 1
        elif tag in ("h1", "article", "main") and not inside:
            self.headed[around] = True
        here = len(self.stack)
        self.places.setdefault(tag, []).append(here)
        self.stack.append((
            tag, not kept and (inside or kind == SURE), container, around,
            here if tag in CONTAINER or tag in ("ul", "ol", "dl") else stop, here if tag in BLOCK else block))

    def _end_head(self) -> None:
        if self.places.get("head"):
            self._cut(self.places["head"][0])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        place = self._open(tag)
        # A stray end tag of an inline element doesn't close the blocks around it.
        if place >= 0 and (tag in BLOCK or place >= self._where()[5]):
            self._cut(place)

    def handle_data(self, data: str) -> None:
        if self._where()[0] == "head" and data.strip():
            self._end_head()
        tag, inside, _, around, *_ = self._where()
        if not inside:
            self.parts.append(data)
            if tag not in ("a", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.plain[around] += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass

    def close(self) -> None:
        super().close()
        self._flush()


def page_lines(parser: Lines) -> list[tuple[str, int, int]]:
    """Lines outside surroundings. Those by name or form stay if they hold most of the page's plain text.

    They also need a headline, an article or a main part inside, or hardly any text outside; a
    thread of comments needs the former.
    """
    size, headed = parser.plain.copy(), parser.headed.copy()
    for k in range(len(size) - 1, 0, -1):  # inner ones come last
        size[parser.around[k]] += size[k]
        headed[parser.around[k]] |= headed[k]
    stays = [True]
    for k in range(1, len(size)):
        wraps = headed[k] or (not parser.thread[k] and parser.plain[0] <= 0.1 * size[k])
        stays.append(stays[parser.around[k]] and 2 * size[k] > size[0] and wraps)
    return [line for *line, k in parser.found if stays[k]]


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and weighted anew."""
    radius = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(x, kernel)[radius : radius + len(x)]
    return full / np.convolve(np.ones(len(x)), kernel)[radius : radius + len(x)]


def content_lines(
    lines: list[tuple[str, int, int]], parents: list[int], sigma: float = 1.0, share: float = 0.5
) -> list[str]:
    """Lines of the containers that are content.

    A container is content if `share` of its text lies in content regions and its own ratio isn't
    far below the threshold (smoothing lifts a list of links between two paragraphs), or if it
    stands inside one that is. The one with most text in regions always is.
    """
    if not lines:
        return []
    size = np.array([len(t) for t, _, _ in lines], dtype=np.float64)
    tags = np.maximum([n for _, n, _ in lines], 1)
    ratio = smooth(size / tags, sigma)
    threshold = min(ratio.std(), ratio.max())
    place = np.array([c for _, _, c in lines])
    total = np.bincount(place, size, len(parents))
    inside = np.bincount(place, size * (ratio >= threshold), len(parents))
    own = total / np.maximum(np.bincount(place, tags, len(parents)), 1)
    chosen = (total > 0) & (inside >= share * total) & (own >= threshold / 2)
    chosen[np.argmax(inside)] = True
    for c, parent in enumerate(parents):  # parents come first
        chosen[c] |= parent > 0 and chosen[parent]
    return [t for t, _, c in lines if chosen[c]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser gives up on some broken declarations; what it read counts
        parser._flush()
    return "\n".join(content_lines(page_lines(parser), parser.parents))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html; others ignored).

    Null and empty pages, and pages of surroundings only, give an empty text and 0. Repeated rows
    are extracted one by one. Character references are decoded; white space inside a block is one
    space; blocks are joined by one line feed, whole. Empty input: no rows.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
