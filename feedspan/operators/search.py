"""Many searches at once over an exploded token table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspan.functions.text import tokens


def token_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key), one row per distinct token of a text.

    The outer explode keeps Catalyst from inferring a filter that would tokenise twice.
    """
    exploded = docs.select(F.explode_outer(tokens(F.col(text))).alias("token"), F.col(key))
    return exploded.filter(F.col("token").isNotNull())


def search_all(
    docs: DataFrame,
    searches: DataFrame,
    key: str,
    text: str,
    search_key: str = "search_id",
    search_text: str = "search_text",
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """(search_key, key) for every search whose tokens all occur in the text.

    Only the rarest token of a search is joined, and the other tokens are checked on
    the candidate row. A frequent token is cut into slices by document hash, with the
    search copied once per slice, so one token never lands in one task. Searches with
    no token, or with a token no text has, match nothing.
    """
    index = token_index(docs, key, text)
    wanted = searches.select(search_key, tokens(F.col(search_text)).alias("__wanted"))
    terms = wanted.select(
        search_key, "__wanted", F.explode_outer("__wanted").alias("token")
    ).filter(F.col("token").isNotNull())
    # Counted before any join, so a token of every text is one row per task.
    frequency = index.groupBy("token").agg(F.count(F.lit(1)).alias("__df"))
    rarest = (
        terms.join(frequency, "token", "left")
        .groupBy(search_key)
        .agg(
            F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), "token")).alias("__r"),
            F.first("__wanted").alias("__wanted"),
        )
        .select(search_key, "__wanted", "__r.token", "__r.df")
        .filter(F.col("df") > 0)
    )
    slices = F.ceil(F.col("df") / F.lit(rows_per_slice)).cast("int")
    cut = rarest.select("token", slices.alias("__n")).distinct()
    sliced = (
        index.join(cut, "token")
        .withColumn("__slice", F.pmod(F.xxhash64(key), F.col("__n")).cast("int"))
        .drop("__n")
    )
    copies = rarest.withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("df")
    candidates = sliced.join(copies, ["token", "__slice"]).select(search_key, "__wanted", key)
    return (
        candidates.join(docs.select(key, F.col(text).alias("__text")), key)
        .filter(F.size(F.array_except("__wanted", tokens(F.col("__text")))) == 0)
        .select(search_key, key)
    )
