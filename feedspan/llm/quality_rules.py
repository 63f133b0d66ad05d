"""Quality rules whose cutoffs come from the data: quantile sketches per language and source.

`text_signals` measures every text, `adaptive_fences` turns the signals of the rows that pass
the base rules into mergeable relative-error quantile sketches (counts per logarithmic bin:
two sketches merge by adding counts), and `quality_rules` joins every row with the fences of
its group. Groups of few rows take the sketch merged over their language, then over all rows.

No cutoff is fixed: a fence lies beyond a quantile of the group's own sketch by a multiple of the
distance between two of its quantiles, and a text is out only if it passes the fence by more than
the sampling error of its own count, so a short text isn't judged on one or two symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspan.sources.storage import staged

SYMBOLS = str.maketrans("", "", "#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Sketch: bins grow by 2 %, the first one holds all below a thousandth.
FIRST, GROWTH = 1e-3, 1.02

#: signal: (numerator, denominator, lower and upper quantile in percent, fence width in their distances,
#: whether small values are out too). Symbols mark junk where most texts have none; repeated lines and
#: words occur in good texts too, so their quantile lies further out. The first rule broken is told.
SIGNALS = {
    "symbols": ("n_symbols", "n_words", 50, 90, 3.0, False),
    "dup_lines": ("n_dup_lines", "n_lines", 75, 99, 1.0, False),
    "repeats": ("n_repeat_words", "n_words", 75, 99, 1.0, False),
    "word_len": ("word_chars", "n_words", 25, 75, 3.0, True),
}
#: Standard errors of a text's count by which it must pass a fence.
ERRORS = 3.0


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text. Lines count if they hold a word."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    repeated = 0
    if len(seq) > 3:
        pair = seq[:-1] * len(ids) + seq[1:]
        if len(ids) > 1_000_000:  # three ids would not fit 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        covered = np.zeros(len(seq), dtype=bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\v\f"):
            lines += 1
            dup += line in seen
            seen.add(line)
    # White space is ASCII, so code points in words are code points less those bytes.
    space = sum(text.count(c) for c in " \t\n\r\v\f")
    symbols = len(text) - len(text.translate(SYMBOLS))
    return len(words), len(text) - space, symbols, lines, dup, repeated


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [count_text(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = np.array(counts, dtype=np.int64).reshape(-1, len(COUNTS)).T
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(c) for c in columns)],
            names=[*batch.schema.names[:-1], *COUNTS],
        )


def text_signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text, one row per input row."""
    kept = docs.select("doc_id", "lang", "source", "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:3])
    return kept.mapInArrow(_count_batches, f"{fields}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(x: Column) -> Column:
    steps = F.ceil(F.log(x / FIRST) / math.log(GROWTH)).cast("int")
    return F.when(x > FIRST, steps).otherwise(F.lit(0))


def _value(bin_: Column) -> Column:
    return F.when(bin_ > 0, F.lit(FIRST) * F.pow(F.lit(GROWTH), bin_)).otherwise(F.lit(0.0))


def adaptive_fences(signals: DataFrame, min_rows: int = 100) -> DataFrame:
    """`low_<signal>` and `high_<signal>` of every (lang, source), from sketches of passing rows.

    A fence lies `width` distances between the two quantiles of a signal beyond the upper or lower
    one. Null languages and sources are groups.
    """
    passing = signals.filter(~base_failed())
    long = passing.select(
        "lang", "source",
        F.explode(F.array(*(
            F.struct(F.lit(k).alias("signal"), _bin(F.col(top) / F.greatest(F.col(below), F.lit(1))).alias("bin"))
            for k, (top, below, *_) in SIGNALS.items()
        ))).alias("s"),
    )
    cells = long.groupBy("lang", "source", "s.signal", "s.bin").agg(F.count("*").alias("n"))
    by_source = cells.withColumn("level", F.lit(0))
    by_lang = cells.groupBy("lang", "signal", "bin").agg(F.sum("n").alias("n")).withColumn("level", F.lit(1))
    overall = cells.groupBy("signal", "bin").agg(F.sum("n").alias("n")).withColumn("level", F.lit(2))
    sketches = by_source.unionByName(by_lang, True).unionByName(overall, True)

    group = Window.partitionBy("level", "lang", "source", "signal")
    below = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumn("upto", F.sum("n").over(below)).withColumn("rows", F.sum("n").over(group))
    percent = [F.lit(None).cast("int")] * 2
    for k, (_, _, lower, upper, _, _) in SIGNALS.items():
        percent = [F.when(F.col("signal") == k, q).otherwise(p) for q, p in zip((lower, upper), percent, strict=True)]
    quantiles = ranked.groupBy("level", "lang", "source", "signal").agg(
        F.first("rows").alias("rows"),
        *(_value(F.min(F.when(F.col("upto") * 100 >= F.col("rows") * p, F.col("bin")))).alias(name)
          for name, p in zip(("lower", "upper"), percent, strict=True)),
    )
    spread, columns = F.col("upper") - F.col("lower"), []
    for k, (_, _, _, _, width, both) in SIGNALS.items():
        mine = F.col("signal") == k
        columns.append(F.max(F.when(mine, F.col("upper") + width * spread)).alias(f"high_{k}"))
        if both:
            columns.append(F.max(F.when(mine, F.col("lower") - width * spread)).alias(f"low_{k}"))
    wide = staged(quantiles.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *columns), "fences")
    names = [c for c in wide.columns if c.startswith(("high_", "low_"))]

    level = {
        n: wide.filter(F.col("level") == n).select(
            *("lang", "source")[: 2 - n], F.struct("rows", *names).alias(f"l{n}"))
        for n in range(2)
    }
    overall = wide.filter("level = 2").first()  # one row, or none without a passing row
    total = F.struct(*(F.lit(overall[c] if overall else None).cast(wide.schema[c].dataType).alias(c) for c in ["rows", *names]))
    # Every group, also one whose rows all fail the base rules.
    groups = signals.select("lang", "source").distinct()
    same = F.col("g.lang").eqNullSafe(F.col("s.lang"))
    joined = (
        groups.alias("g")
        .join(level[0].alias("s"), same & F.col("g.source").eqNullSafe(F.col("s.source")), "left")
        .select("g.*", "l0").alias("g")
        .join(level[1].alias("s"), same, "left").select("g.*", "l1")
    )
    chosen = F.when(F.col("l0.rows") >= min_rows, F.col("l0")).when(F.col("l1.rows") >= min_rows, F.col("l1"))
    return joined.select("lang", "source", chosen.otherwise(total).alias("f")).select("lang", "source", "f.*")


def quality_rules(docs: DataFrame, min_rows: int = 100) -> DataFrame:
    """Verdict on every row: base counts, base_failed, kept and the first rule broken.

    docs: doc_id, text, lang, source; other columns are ignored. A null or empty text has no
    words and fails the base rules. Repeated rows are judged one by one. Without any passing
    row there are no fences, and `kept` is what the base rules say. Empty input: no rows.
    """
    signals = staged(text_signals(docs), "quality-signals")
    fences = adaptive_fences(signals, min_rows).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    judged = signals.join(
        fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    failed, rule = base_failed(), F.when(base_failed(), F.lit("base"))
    for k, (top, below, _, _, _, both) in SIGNALS.items():
        n = F.greatest(F.col(below), F.lit(1))
        x, error = F.col(top) / n, ERRORS * F.sqrt(F.col(top)) / n
        rule = rule.when(x > F.col(f"high_{k}") + error, F.lit(f"{k}_high"))
        if both:
            rule = rule.when(x < F.col(f"low_{k}") - error, F.lit(f"{k}_low"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), rule.isNull().alias("kept"), rule.alias("rule"),
    )
