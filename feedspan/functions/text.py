"""Token search as column expressions: every query token must occur in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token classes, in the order in which they are tried at a place. Java and RE2 read them alike.
WORD = r"[\p{L}\p{N}]+"
_LABELS = r"(?:[A-Za-z0-9][A-Za-z0-9_-]*\.)+[A-Za-z][A-Za-z]+"
HOST = rf"{_LABELS}(?::[0-9]+)?"
PATH = r"/[!#-;=?-Z\[\]_a-z~]*"
HYPHENATED = rf"\p{{L}}[\p{{L}}\p{{N}}]*(?:-{WORD})+"
CLASSES = {
    "comment": r"<!--[^>]*-->",
    "tag": r"</?[A-Za-z][^<>]*>",
    "entity": r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+);",
    "email": rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._-]*@{_LABELS}",
    "protocol": r"[A-Za-z]+://",
    "url": HOST + PATH,
    "host": HOST,
    "file": r"(?:/?(?:[A-Za-z0-9_.~-]+/)+|/)[A-Za-z0-9_.~-]*[A-Za-z0-9_~]",
    "scientific": r"[-+]?[0-9]+(?:\.[0-9]+)?[eE][-+]?[0-9]+",
    "version": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)+",
    "decimal": r"[-+]?[0-9]+\.[0-9]+",
    "numbered word": r"[0-9]+\p{L}[\p{L}\p{N}]*",
    "hyphenated": HYPHENATED,
    "number": r"[-+]?[0-9]+",
    "word": WORD,
}
TOKEN = "|".join(CLASSES.values())
# Without one of these no class but words and plain numbers can begin.
COMPOUND = r"[-+./@:&<][\p{L}\p{N}/#!]"
SEPARATORS = r"[^\p{L}\p{N}]+"


def _with_parts(token: Column) -> Column:
    """The tokens one place gives: an address also its host and path, a hyphenated word its parts; markup none."""
    is_url = token.rlike(f"^{HOST}/")
    host = F.regexp_extract(token, f"^{HOST}", 0)
    path = F.substring(token, F.length(host) + 1, F.length(token))
    return (
        F.when(token.rlike("^[<&]|://$"), F.array().cast("array<string>"))
        .when(is_url, F.array(token, host, path))
        .when(token.rlike(f"^{HYPHENATED}$"), F.concat(F.array(token), F.split(token, "-")))
        .otherwise(F.array(token))
    )


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens; no stemming, no stop words.

    Words and numbers, and as wholes: e-mail addresses, web addresses (also their host and path),
    hosts, file paths, hyphenated words (also their parts), signed and decimal numbers, versions.
    Markup, entities and protocols give none. Texts without a sign that could join two words are
    split at once.
    """
    low = F.lower(text)
    found = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), _with_parts))
    plain = F.filter(F.split(low, SEPARATORS), lambda t: t != "")
    return F.array_distinct(F.when(text.rlike(COMPOUND), found).otherwise(plain))


def token_match(text: Column, query: str | None) -> Column:
    """True where all tokens of `query` occur in `text`.

    A blank query matches everything; a query without a single token matches nothing.
    """
    if not query:
        return F.lit(True)
    wanted = tokens(F.lit(query))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(text))) == 0)
