"""Row ids without a sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _encoded(part: Column) -> Column:
    """A value with its length before it, so that parts can't run together; NULL has a sign of its own."""
    text = part.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def stable_uuid(*key: Column) -> Column:
    """A UUID-shaped hash of a key: the same row gets the same id on a rerun.

    All 128 bits of the hash are kept. Key parts are told apart by their lengths, and NULL differs
    from every text: ('ab', 'c'), ('a', 'bc'), ('abc', NULL) and (NULL, 'abc') give four ids.
    """
    digest = F.md5(F.concat(*map(_encoded, key)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in cuts])
