"""Licence recognition by sentences: known sentences become identifiers, rules match their order."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame

# Wording of public licences, as patterns over normalised sentences
# (lower case, "license", no quotes or comment marks, single spaces). Of matches that overlap the
# first wins, and of those that begin together the one listed first.
# The middle names words of which every match holds one: a text without them is not searched.
GRANT = (
    r"\b(?:licensed|released|distributed|available|provided|published|shared|covered) (?:under|by) "
    r"(?:either )?(?:of )?(?:the |a )?(?:terms of )?(?:either )?(?:of )?(?:the |a )?"
)
#: What stands between the licences of a list: "or", "and/or", a comma, a slash.
JOIN = r"(?: license)?(?: ?\([^()]*\))?(?: ?[,;/]? ?(?:and/or|or|and)\b| ?[,;/])(?: ?\(?at your (?:option|choice)\)?,?)?(?: (?:under|by))? ?(?:the |a )?(?:terms of )?(?:the |a )?"
#: A licence's name without the word, as "MIT" in "the MIT or Apache License".
BEFORE_NEXT = r"(?=" + JOIN + r"(?:apache|(?:new |simplified |modified |[0-9]-clause )?bsd|gnu|[al]?gpl|mozilla|cc|creative commons)\b)"
#: What follows at any distance may not lie beyond the name of another licence.
OTHER = re.compile(r"\b(?:apache|mozilla|mit|expat|bsd|creative commons|[al]?gpl)\b")
VERSION = re.compile(r"\bversion (?P<gnuv>[0-9](?:\.[0-9])?)")
ANY_LATER = re.compile(r"\bany (?P<later>later) version\b")
LATER = re.compile(r"\b(?P<glater>later)\b")
SPDX_TERM = r"\(*[a-z0-9.+:-]*[a-z0-9.+]\)*"
SENTENCES = [
    ("Negated", "under", r"\bnot (?:be )?(?:licensed|released|distributed|available) under\b"),
    ("Spdx", "spdx", r"\bspdx-license-identifier: ?(?P<spdx>" + SPDX_TERM + r"(?: (?:or|and|with) " + SPDX_TERM + r")*)"),
    ("MitGrant", "permission", r"\bpermission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MitNotice", "permission", r"\bthe above copyright notice and this permission notice shall be included"),
    ("IscGrant", "permission", r"\bpermission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("AsIs", "provided", r"\bsoftware is provided (?=as[ -]is\b|by the [a-z ])"),
    ("NoLiability", "liable", r"\bin no event shall\b"),
    ("BsdGrant", "redistribution", r"\bredistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BsdSource", "redistributions", r"\bredistributions of source code must retain\b"),
    ("BsdBinary", "redistributions", r"\bredistributions in binary form must reproduce\b"),
    ("BsdEndorse", "endorse", r"\bneither the names? of\b"),
    ("BsdAdvert", "advertising", r"\ball advertising materials mentioning features\b"),
    ("GplFree", "free", r"\bthis (?:program|library|file) is free software\b"),
    ("GplNoWarranty", "distributed", r"\bdistributed in the hope that it will be useful\b"),
    ("GplCopy", "gnu", r"\byou should have received a copy of the gnu\b"),
    ("Apache", "apache", GRANT + r"apache(?: software)?(?: license)?,?(?: (?:version|v\.?))?[ -]?(?P<apache>[12](?:\.[0-9])?)?"),
    ("ApacheLimits", "applicable", r"\bunless required by applicable law or agreed to in writing, software distributed under the license"),
    ("ApacheCopy", "obtain", r"\byou may obtain a copy of the license at\b"),
    ("Mit", "mit expat", GRANT + r"(?:mit|expat)(?:[ /]x11)?(?:-style)?(?: ?licenses?\b|" + BEFORE_NEXT + r")|^(?:the )?mit license$"),
    ("Bsd", "bsd", GRANT + r"(?:(?:new |simplified |modified )?bsd|(?P<bsd>[0-4])-clause bsd|bsd (?P<bsd2>[0-4])-clause)(?:-style)? ?(?:license)?\b"),
    ("Gnu", "public gpl gfdl documentation", GRANT + r"(?:gnu )?(?P<family>lesser general public license|affero general public license|general public license|free documentation license|agpl|lgpl|gfdl|gpl),?(?: ?\(?(?:l|a)?gpl\)?,?)?(?: (?:version|v\.?) ?| ?-?v?)?(?P<gv>[0-9](?:\.[0-9])?)?"),
    ("Mpl", "mozilla", r"\bmozilla public license,?(?: (?:version|v\.?))? ?(?P<mpl>[0-9]\.[0-9])?"),
    ("CreativeCommons", "cc commons", GRANT + r"(?:cc|creative commons)[ -](?P<cc>zero|0|attribution(?:[ -](?:non-?commercial|share-?alike|no-?deriv(?:ative)?s?(?: works)?))*|by(?:-nc)?(?:-sa|-nd)?)(?: (?:international|unported|generic))?(?: license)?,?(?: (?:version|v\.?))? ?(?P<ccv>[0-9]\.[0-9])?"),
    ("PublicDomain", "domain", r"\b(?:dedicated|released|placed|donated) (?:to|into|in) the public domain\b|\bthis (?:work|file|software) is in the public domain\b"),
    ("AllRights", "reserved", r"\ball rights reserved\b"),
    ("Copyright", "copyright (c)", r"^(?:portions )?copyright\b|^\(c\) (?:copyright )?[0-9]{4}"),
]
#: The end of a known sentence that begins as above, at any distance, and what may not stand between.
ENDS = {
    "AsIs": (r"\bas[ -]is\b", r"[^a-z ]"),
    "NoLiability": (r"\bbe liable\b", None),
    "BsdEndorse": (r"\bmay be used to endorse\b", None),
    "GplFree": (r"\b(?P<gnu>lesser general|library general|affero general|general) public license\b", None),
}
#: What may follow at any distance, in this order, if no other licence is named before it.
TAILS = {"GplFree": [VERSION, ANY_LATER], "Gnu": [LATER]}


class Sentence:
    """A sentence and the places of patterns in it, each searched once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.places: dict[re.Pattern, tuple[list[int], list[re.Match]]] = {}

    def first(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The first match that begins at `at` or later."""
        if pattern not in self.places:
            matches = list(pattern.finditer(self.text))
            self.places[pattern] = [m.start() for m in matches], matches
        starts, matches = self.places[pattern]
        i = bisect_left(starts, at)
        return matches[i] if i < len(starts) else None


class Phrase:
    """A known sentence: a beginning, perhaps an end at any distance, and what may follow that.

    A pattern that ran over the distance would be tried anew from each beginning, which takes
    quadratic time where beginnings repeat; here each part is searched once in a sentence.
    """

    def __init__(self, name: str, head: str) -> None:
        end, apart = ENDS.get(name, (None, None))
        self.head, self.tails = re.compile(head), TAILS.get(name, [])
        self.end, self.apart = end and re.compile(end), apart and re.compile(apart)

    def _whole(self, sentence: Sentence, m: re.Match) -> tuple[int, int, dict] | None:
        """Start, end and named parts of the phrase that begins with `m`."""
        found, at = {k: v for k, v in m.groupdict().items() if v}, m.end()
        if self.end:
            end = sentence.first(self.end, at)
            between = self.apart and sentence.first(self.apart, at)
            if not end or (between and between.start() < end.start()):
                return None
            found, at = found | end.groupdict(), end.end()
        for tail in self.tails:
            follows, other = sentence.first(tail, at), sentence.first(OTHER, at)
            if follows and not (other and other.start() < follows.start()):
                found, at = found | follows.groupdict(), follows.end()
            elif tail is LATER and sentence.text.startswith("+", at):
                found, at = found | {"glater": "+"}, at + 1
        return m.start(), at, found

    def find_all(self, sentence: Sentence) -> Iterator[tuple[int, int, dict]]:
        at = 0
        while m := self.head.search(sentence.text, at):
            whole = self._whole(sentence, m)
            if whole:
                yield whole
            elif self.end and not sentence.first(self.end, m.end()):
                return  # none that begins later has an end either
            at = max(whole[1] if whole else m.end(), m.start() + 1)

    def search(self, text: str) -> tuple[int, int, dict] | None:
        return next(self.find_all(Sentence(text)), None)

    def match(self, sentence: Sentence, at: int) -> tuple[int, int, dict] | None:
        m = self.head.match(sentence.text, at)
        return self._whole(sentence, m) if m else None


KNOWN = [(name, tuple(words.split()), Phrase(name, pattern)) for name, words, pattern in SENTENCES]
#: Patterns of licences that may follow another one in a list.
LISTED = [
    (name, Phrase(name, pattern.removeprefix(GRANT).replace(BEFORE_NEXT, r"(?=$| ?[,;/)]| (?:or|and|at)\b)").split("|^")[0]))
    for name, _, pattern in SENTENCES if pattern.startswith(GRANT) or name == "Mpl"
]
LIST_START = {name for name, _ in LISTED}
NEXT = re.compile(JOIN)
DENIED = re.compile(r" ?(?:either )?(?:of )?(?:the |a )?(?:terms of )?(?:the |a )?")

#: Ordered rules: the first that matches at a place wins, so longer ones come first.
RULES = [
    (("MitGrant", "MitNotice", "AsIs", "NoLiability"), "MIT"),
    (("MitGrant", "MitNotice", "AsIs"), "MIT"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("Mit", "MitGrant", "MitNotice", "AsIs", "NoLiability"), "MIT"),
    (("IscGrant", "AsIs", "NoLiability"), "ISC"),
    (("IscGrant", "AsIs"), "ISC"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse", "AsIs", "NoLiability"), "BSD-4-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "AsIs", "NoLiability"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("GplFree", "GplNoWarranty", "GplCopy"), "{gnu}"),
    (("GplFree", "GplNoWarranty"), "{gnu}"),
    (("GplFree",), "{gnu}"),
    (("Apache", "ApacheCopy", "ApacheLimits"), "{apache}"),
    (("Apache",), "{apache}"),
    (("Mit",), "MIT"),
    (("Bsd",), "{bsd}"),
    (("Gnu",), "{gnu}"),
    (("Mpl",), "{mpl}"),
    (("CreativeCommons",), "{cc}"),
    (("Spdx",), "{spdx}"),
    (("PublicDomain",), "public-domain"),
]
# Longest first, whatever the order above; rules of one length keep it.
RULES.sort(key=lambda r: -len(r[0]))
GNU = {
    "lesser general": "LGPL", "library general": "LGPL", "affero general": "AGPL", "general": "GPL",
    "lesser general public license": "LGPL", "affero general public license": "AGPL", "general public license": "GPL",
    "free documentation license": "GFDL", "agpl": "AGPL", "lgpl": "LGPL", "gfdl": "GFDL", "gpl": "GPL",
}
CREATIVE = {
    "attribution": "by", "attribution-noncommercial": "by-nc", "attribution-sharealike": "by-sa",
    "attribution-noderivatives": "by-nd", "attribution-noncommercial-sharealike": "by-nc-sa",
    "attribution-noncommercial-noderivatives": "by-nc-nd", "zero": "0",
}
#: Spelling of identifiers that are found in lower case; others stay as found.
SPDX = {x.lower(): x for x in (
    "MIT ISC BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only "
    "GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only "
    "AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense Zlib EPL-2.0"
).split()}
SPLIT = re.compile(r"(?<=[.!?])[)\"'»”]*\s+|\n\s*\n")
MARKS = re.compile(r"^[\s/*#;%!<>-]+|[\"'`“”«»*]+", re.M)
#: Lines that are sentences of their own: copyright lines begin one, SPDX lines begin and end one.
OWN_LINE = re.compile(
    r"^(?P<line>(?:[/*#;%!<>-]|[^\S\n])*(?:(?P<spdx>spdx-license-identifier:)|"
    r"(?:portions )?copyright\b[^\S\n]*(?:\(c\)|©|&copy;|[0-9]{4}|by\b)|\(c\) ?(?:copyright )?[0-9]{4}|©)[^\n]*)$", re.M | re.I)
#: A copyright line that the next line goes on with.
OPEN_END = re.compile(r"\b(?:licen[cs]ed|released|distributed|available|provided|published|shared|covered)\b|(?:,|\b(?:and|or|by|of|the))\s*$", re.I)


def _own_line(m: re.Match) -> str:
    line = m["line"]
    return f"\n\n{line}" if not m["spdx"] and OPEN_END.search(line) else f"\n\n{line}\n\n"


def sentences(text: str) -> list[str]:
    """Normalised sentences.

    A line break ends one only after end punctuation, before a blank line, and at copyright lines
    and SPDX lines.
    """
    out = []
    for raw in SPLIT.split(OWN_LINE.sub(_own_line, text)):
        plain = " ".join(MARKS.sub(" ", raw).lower().replace("licence", "license").split()).rstrip(".;:!? ")
        if plain:
            out.append(plain)
    return out


def _spdx_parts(expression: str) -> list[str]:
    """Licences of an expression; an exception stays with its licence, prose behind it ends it."""
    out, operator = [], "or"
    for n, word in enumerate(expression.replace("(", "").replace(")", "").split()):
        if n % 2:
            operator = word
        elif n and not (word in SPDX or re.search(r"[0-9.+:-]", word)):
            break
        elif operator == "with":
            out[-1] += f" with {word}"
        else:
            out.append(word)
    return out


def _listed(sentence: Sentence, end: int, before: re.Pattern) -> tuple[list[tuple[str, dict]], int]:
    """The licences of a list that goes on at `end`, the first one behind `before`, and its end."""
    out = []
    while joined := before.match(sentence.text, end):
        matches = ((name, phrase.match(sentence, joined.end())) for name, phrase in LISTED)
        name, m = next((x for x in matches if x[1]), (None, None))
        if not m:
            break
        out.append((name, m[2]))
        end, before = m[1], NEXT
    return out, end


def identify_sentence(sentence: str, patterns: list = KNOWN) -> list[tuple[str, dict]]:
    """All known sentences in a sentence, by position; a list of licences gives one each."""
    here = Sentence(sentence)
    matches = sorted(
        ((*m, k, name) for k, (name, _, phrase) in enumerate(patterns) for m in phrase.find_all(here)),
        key=lambda x: (x[0], x[3]))
    out, end = [], 0
    for start, stop, found, _, name in matches:
        if start < end:
            continue
        end = stop
        if name == "Spdx":
            out += [(name, {"spdx": part}) for part in _spdx_parts(found["spdx"])]
            continue
        out.append((name, found))
        if name == "Negated":  # what follows is denied too
            _, end = _listed(here, end, DENIED)
        elif name in LIST_START:
            more, end = _listed(here, end, NEXT)
            out += more
    return out


def _named(template: str, found: dict) -> str:
    if template == "{gnu}":
        family = GNU[found.get("gnu") or found.get("family")]
        version = found.get("gnuv") or found.get("gv")
        if not version:
            return family
        version = version if "." in version else f"{version}.0" if family != "GFDL" else version
        return f"{family}-{version}-{'or-later' if found.get('later') or found.get('glater') else 'only'}"
    if template == "{apache}":
        version = found.get("apache")
        return f"Apache-{version if '.' in version else version + '.0'}" if version else "Apache"
    if template == "{bsd}":
        clauses = found.get("bsd") or found.get("bsd2")
        return f"BSD-{clauses}-Clause" if clauses else "BSD"
    if template == "{mpl}":
        return f"MPL-{found['mpl']}" if "mpl" in found else "MPL"
    if template == "{cc}":
        kind = found["cc"].replace(" works", "").replace(" ", "-").replace("non-", "non").replace("no-", "no")
        kind = kind.replace("share-", "share").replace("noderivs", "noderivatives").replace("noderivative-", "noderivatives-")
        kind = CREATIVE.get(kind, kind)
        name = "CC0" if kind == "0" else f"CC-{kind.upper()}"
        return f"{name}-{found['ccv']}" if "ccv" in found else name
    if template == "{spdx}":
        name, *exception = found["spdx"].rstrip(".").split(" with ")
        return " WITH ".join([SPDX.get(name, name), *exception])
    return template


def match_rules(known: list[tuple[int, str, dict]]) -> list[tuple[str, int, int]]:
    """(licence, first sentence, last sentence) for the rules met by runs of identifiers, left to right.

    Copyright lines and reserved rights are no part of a rule and don't interrupt one.
    """
    ids = [k for k in known if k[1] not in ("Copyright", "AllRights", "Negated")]
    out, i = [], 0
    while i < len(ids):
        for rule, template in RULES:
            if tuple(x[1] for x in ids[i : i + len(rule)]) == rule:
                part = ids[i : i + len(rule)]
                out.append((_named(template, reduce(lambda a, b: {**a, **b[2]}, part, {})), part[0][0], part[-1][0]))
                i += len(rule)
                break
        else:
            i += 1
    return out


def scan_text(text: str | None) -> tuple[list[tuple[str, int, int]], int]:
    """Licences found in a text, and how many known sentences belong to none of them."""
    if not text:
        return [], 0
    low = text.lower()
    patterns = [k for k in KNOWN if any(w in low for w in k[1])]
    if not patterns:
        return [], 0
    known = []
    for n, s in enumerate(sentences(text)):
        known += [(n, *found) for found in identify_sentence(s, patterns)]
    hits = match_rules(known)
    starts = [a for _, a, _ in hits]  # runs from left to right, so their ends ascend too

    def covered(n: int) -> bool:
        i = bisect_right(starts, n)
        return i > 0 and n <= hits[i - 1][2]

    return hits, sum(1 for n in {x[0] for x in known} if not covered(n))


SCHEMA = "licenses array<string>, spans array<struct<license string, first int, last int>>, n_unmatched int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        found = [scan_text(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([sorted({x[0] for x in hits}) for hits, _ in found], pa.list_(pa.string())),
                pa.array([[{"license": a, "first": b, "last": c} for a, b, c in hits] for hits, _ in found], span),
                pa.array([n for _, n in found], pa.int32()),
            ],
            names=["doc_id", "licenses", "spans", "n_unmatched"],
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences of every row: doc_id, licenses (distinct, sorted), spans of sentences, n_unmatched.

    docs: doc_id, text; other columns are ignored. Null and empty texts, and texts without a known
    sentence, have empty arrays and 0. Repeated rows are scanned one by one. Empty input: no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
