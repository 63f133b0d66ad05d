"""HTML sanitising for feed text, as an Arrow-batched column function.

`ugc` keeps the formatting tags readers may write and drops everything that can
run; `strict` drops every tag. Text is entity-escaped in both.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements kept, attributes kept per element, elements dropped with their text.
KEPT = frozenset(
    """a abbr acronym article aside b bdi bdo blockquote br caption cite code col colgroup dd del
    details dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr i img ins li map mark
    area meter ol p pre progress q rp rt ruby s samp section small span strike strong sub summary
    sup table tbody td tfoot th thead time tr tt u ul var wbr""".split()
)
GLOBAL_ATTRIBUTES = frozenset(["dir", "id", "lang", "title"])
ATTRIBUTES = {
    "a": {"href"},
    "area": {"alt", "coords", "href", "shape"},
    "blockquote": {"cite"},
    "del": {"cite", "datetime"},
    "details": {"open"},
    "img": {"align", "alt", "height", "src", "width"},
    "ins": {"cite", "datetime"},
    "li": {"type", "value"},
    "map": {"name"},
    "meter": {"high", "low", "max", "min", "optimum", "value"},
    "ol": {"type"},
    "progress": {"max", "value"},
    "q": {"cite"},
    "td": {"abbr", "align", "colspan", "headers", "height", "rowspan", "valign", "width"},
    "th": {"abbr", "align", "colspan", "headers", "height", "rowspan", "scope", "valign", "width"},
    "time": {"datetime"},
    "ul": {"type"},
}
URL_ATTRIBUTES = frozenset(["cite", "href", "src"])
URL_SCHEMES = frozenset(["http", "https", "mailto"])
DROPPED_WITH_TEXT = frozenset(
    """frame frameset iframe noembed noframes noscript nostyle object script style title""".split()
)
NEED_ATTRIBUTES = frozenset(["a", "area", "img", "map"])
VOID = frozenset(["area", "br", "col", "frame", "hr", "img", "wbr"])
# The ampersand comes first, or it would escape the other entities.
ESCAPES = [
    ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\r", "&#13;")
]

_SCHEME = re.compile(r"\s*([a-zA-Z][a-zA-Z0-9+.-]*):")


def escape(text: str) -> str:
    for char, entity in ESCAPES:
        if char in text:
            text = text.replace(char, entity)
    return text


def _safe_url(url: str | None) -> bool:
    if not url or not url.strip():
        return False
    scheme = _SCHEME.match(re.sub(r"[\x00-\x20]+", "", url))
    return scheme is None or scheme.group(1).lower() in URL_SCHEMES


class BoundedParser(HTMLParser):
    """The standard parser in linear time on broken markup.

    What follows the last `>` can hold no whole tag, so it is data at once instead of one try per
    `<`. A comment or section that doesn't end is searched for its end once, not at each beginning.
    """

    tail = ""
    endless: dict[str, int]

    def feed(self, data: str) -> None:
        cut = data.rfind(">") + 1
        self.tail = data[cut:]
        super().feed(data[:cut])

    def close(self) -> None:
        super().close()
        tail, self.tail = self.tail, ""
        if tail:
            self.handle_data(tail if self.cdata_elem else unescape(tail))

    def goahead(self, end) -> None:
        self.endless = {}
        super().goahead(end)

    def _once(self, kind: str, i: int, parse) -> int:
        if i >= self.endless.get(kind, i + 1):
            return -1
        k = parse()
        if k < 0:
            self.endless[kind] = i
        return k

    def parse_comment(self, i, report=1):
        return self._once("<!--", i, lambda: super(BoundedParser, self).parse_comment(i, report))

    def parse_marked_section(self, i, report=1):
        return self._once(self.rawdata[i : i + 9].lower(), i, lambda: super(BoundedParser, self).parse_marked_section(i, report))

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are of no use here


class _Cleaner(BoundedParser):
    def __init__(self, keep_tags: bool):
        super().__init__(convert_charrefs=True)
        self.keep_tags = keep_tags
        self.out: list[str] = []
        self.muted: list[str] = []
        self.bare: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_WITH_TEXT:
            if tag not in VOID:
                self.muted.append(tag)
            return
        if self.muted or not self.keep_tags or tag not in KEPT:
            return
        allowed = ATTRIBUTES.get(tag, frozenset())
        kept = [
            (name, value or "")
            for name, value in attrs
            if name in GLOBAL_ATTRIBUTES
            or (name in allowed and (name not in URL_ATTRIBUTES or _safe_url(value)))
        ]
        if tag in NEED_ATTRIBUTES and not kept:
            if tag not in VOID:
                self.bare.append(tag)
            return
        if tag in ("a", "area") and any(name == "href" for name, _ in kept):
            kept.append(("rel", "nofollow"))
        self.out.append(
            "<" + tag + "".join(f' {n}="{escape(v)}"' for n, v in kept) + ">"
        )

    def handle_startendtag(self, tag, attrs):
        if tag in DROPPED_WITH_TEXT:
            return
        before = len(self.out)
        self.handle_starttag(tag, attrs)
        if len(self.out) > before:
            self.out[-1] = self.out[-1][:-1] + "/>"
        elif self.bare and self.bare[-1] == tag:
            self.bare.pop()

    def handle_endtag(self, tag):
        if self.muted:
            if tag == self.muted[-1]:
                self.muted.pop()
            return
        if not self.keep_tags or tag not in KEPT or tag in VOID:
            return
        if self.bare and self.bare[-1] == tag:
            self.bare.pop()
            return
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.muted:
            self.out.append(escape(data))


def clean_html(text: str | None, strict: bool = False) -> str | None:
    if text is None:
        return None
    if "<" not in text:
        return escape(unescape(text) if "&" in text else text)
    cleaner = _Cleaner(keep_tags=not strict)
    cleaner.feed(text)
    cleaner.close()
    return "".join(cleaner.out)


def sanitize_html(text: Column, strict: bool = False) -> Column:
    """Sanitise a text column."""

    @F.pandas_udf(T.StringType())
    def clean(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: clean_html(v, strict), na_action="ignore")

    return clean(text)


def sanitize_fields(fields: dict[str, Column], strict: bool = False) -> Column:
    """Sanitise several text columns in one Python round trip; the result is a struct."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in fields])

    @F.pandas_udf(schema)
    def clean(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.apply(
            lambda column: column.map(lambda v: clean_html(v, strict), na_action="ignore")
        )

    return clean(F.struct(*[c.alias(name) for name, c in fields.items()]))
