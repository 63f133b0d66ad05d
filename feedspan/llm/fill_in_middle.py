"""Fill-in-the-middle texts by rotating blocks of one buffer, and their exact way back.

The cuts and the form of a text are column expressions over hashes of its id. In the task a text is
a bytearray: sentinels are inserted at the cuts, and the segments change places by rotations made of
three reversals each, in pieces of bounded size. Restoring finds the sentinels, rotates back and
takes them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 16  # bytes that a reversal holds beside the buffer


def _reverse(buf: bytearray, a: int, b: int) -> None:
    """Reverse buf[a:b] in place, swapping pieces from both ends."""
    while b - a > 1:
        step = min(PIECE, (b - a) // 2)
        head = buf[a : a + step]
        buf[a : a + step] = buf[b - step : b][::-1]
        head.reverse()
        buf[b - step : b] = head
        a, b = a + step, b - step


def rotate(buf: bytearray, a: int, cut: int, b: int) -> None:
    """Exchange the segments buf[a:cut] and buf[cut:b] in place by three reversals."""
    if a < cut < b:
        _reverse(buf, a, cut)
        _reverse(buf, cut, b)
        _reverse(buf, a, b)


def arrange(text: bytes, lo: int, hi: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """A text in UTF-8 with cuts after `lo` and `hi` code points, in the order of `form` (psm, spm or plain)."""
    buf = bytearray(text)
    if form == "plain":
        return buf
    first, second = lo, hi
    if not text.isascii():
        chars = text.decode("utf-8")
        first = len(chars[:lo].encode("utf-8"))
        second = first + len(chars[lo:hi].encode("utf-8"))
    prefix, suffix, middle = marks
    buf[second:second] = suffix
    buf[first:first] = middle
    buf[0:0] = prefix
    cut, end = first + len(prefix), second + len(prefix) + len(middle)  # where middle and suffix begin
    rotate(buf, cut if form == "psm" else 0, end, len(buf))
    return buf


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text of an output of `arrange`; its sentinels occur once each."""
    buf = bytearray(output)
    if form == "plain":
        return buf
    prefix, suffix, middle = marks
    if form == "psm":
        cut = buf.find(suffix)
        end = buf.find(middle, cut)
        rotate(buf, cut, end, len(buf))
        second = len(buf) - (end - cut)
    else:
        end = buf.find(prefix)
        rotate(buf, 0, end, len(buf))
        cut, second = buf.find(middle), len(buf) - end
    del buf[second : second + len(suffix)]
    del buf[cut : cut + len(middle)]
    del buf[: len(prefix)]
    return buf


def _draw(key: Column, group: int) -> Column:
    """The `group`th eight hex digits of a hash as an unsigned integer."""
    return F.conv(F.substring(key, 8 * group + 1, 8), 16, 10).cast("long")


def _with_cuts(docs: DataFrame, seed: int, plain: int, spm: int, marks: tuple[str, str, str]) -> DataFrame:
    text, key = F.coalesce("text", F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    rows = docs.select("doc_id", text.alias("text"), key.alias("key")).withColumn("n", F.length("text").cast("long"))
    one, two = _draw(F.col("key"), 0) % (F.col("n") + 1), _draw(F.col("key"), 1) % (F.col("n") + 1)
    form = (
        F.when((F.col("n") == 0) | marked | (_draw(F.col("key"), 2) % 100 >= 100 - plain), "plain")
        .when(_draw(F.col("key"), 3) % 100 < spm, "spm").otherwise("psm")
    )
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("lo"), F.greatest(one, two).alias("hi"))


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _strings(buffers: list[bytearray]) -> pa.Array:
    return pa.array([bytes(b) for b in buffers], pa.binary()).cast(pa.string())


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every row of `docs` (doc_id, text).

    `plain` of 100 texts stay as they are, and so do empty texts and those that hold a sentinel;
    of the others `spm` of 100 begin with the suffix. Cuts depend on `seed` and doc_id alone, so
    repeated rows give equal rows; a null id counts as an empty one. A null text is empty. Other
    columns are ignored. Empty input: no rows.
    """
    raw = tuple(m.encode("utf-8") for m in marks)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, lo, hi = (batch.column(c).to_pylist() for c in ("form", "lo", "hi"))
            out = [arrange(t, a, b, f, raw) for t, a, b, f in zip(_binary(batch.column("text")), lo, hi, form, strict=True)]
            cut = [f != "plain" for f in form]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n"), batch.column("form"),
                    pa.array([a if c else None for a, c in zip(lo, cut, strict=True)], pa.int64()),
                    pa.array([b - a if c else None for a, b, c in zip(lo, hi, cut, strict=True)], pa.int64()),
                    _strings(out),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _with_cuts(docs, seed, plain, spm, marks).mapInArrow(
        apply, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_texts(arranged: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """The rows of `fill_in_middle` with `restored`, the text rebuilt from output and form alone."""
    raw = tuple(m.encode("utf-8") for m in marks)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(t, f, raw) for t, f in zip(_binary(batch.column("output")), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(texts)], names=[*batch.schema.names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arranged.schema)
    return arranged.mapInArrow(apply, f"{fields}, restored string")


def fim_digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of `fill_in_middle` with hashes of the output and of the restored text in their place."""
    kept = [F.col(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
    return restore_texts(fill_in_middle(docs, seed)).select(
        *kept, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
