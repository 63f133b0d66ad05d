"""Fixtures that every operator must survive."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("node", T.LongType()),
    T.StructField("n_tokens", T.StringType()), T.StructField("taken", T.StringType()),
])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that depends on the seed; runs of five hardly repeat."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 16) % len(WORDS)] + str((state >> 8) % 10))
    return " ".join(out)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(("en", "src1") if len(r) == 2 else ()), 0, "x", "y", 5, "z", "t") for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Null ids, texts, languages and sources, empty and blank texts, a repeated row, a very long text."""
    long = prose(3, 40_000)
    return documents(spark, [
        (1, prose(1, 80)), (2, None), (3, ""), (4, " \n\t "), (None, prose(2, 60)), (None, None, None, None),
        (5, prose(5, 60), None, None), (6, prose(6, 60)), (6, prose(6, 60)), (7, long), (8, "1 2 3 ..."), (9, "\n".join(["same line"] * 40)),
    ])
