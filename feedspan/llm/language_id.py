"""Language identification by prediction by partial matching (PPM).

Per language, byte contexts of up to four bytes form a tree with counts. A byte costs
-log2 of its share in the longest known context that has seen it, plus the escape costs of the
longer contexts that have not (escape method C: distinct / (total + distinct)). The trees are
frozen after training; the language with the shortest code for the whole text wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspan.llm.common import bounded_sample, fold

DEPTH = 5  # bytes of a gram: four of context and the one that is coded
PAD = b" " * (DEPTH - 1)
PIECE = 1 << 20  # bytes scored at once
LETTER = re.compile(r"[^\W\d_]")
#: ASCII that isn't a letter becomes a space; bytes of other scripts stay.
FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def plain_bytes(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """Each window of `length` bytes as one number."""
    out = data[length - 1 :].astype(np.uint64)
    for k in range(1, length):
        out |= data[length - 1 - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(PAD + plain_bytes(text))
        for lang, texts in by_lang.items():
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            for length in range(1, DEPTH + 1):
                keys, counts = np.unique(grams(data, length), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(np.full(len(keys), length, dtype=np.int32)),
                     pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "length", "gram", "n"],
                )


def hash_levels(keys: np.ndarray) -> list[tuple[np.ndarray, np.uint64, np.uint64]]:
    """Slot tables over distinct keys; what finds its slot taken goes to the next, smaller table."""
    levels, left, odd = [], np.arange(len(keys), dtype=np.int64), 0x9E3779B97F4A7C15
    while len(left):
        bits = max(8, int(len(left) * 2).bit_length())
        factor, shift = np.uint64(odd), np.uint64(64 - bits)
        slot = (keys[left] * factor) >> shift
        _, first = np.unique(slot, return_index=True)
        tab = np.full(1 << bits, len(keys), dtype=np.int32)
        tab[slot[first]] = left[first]
        levels.append((tab, factor, shift))
        left = np.delete(left, first)
        odd = (odd * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
    return levels


def find(keys: np.ndarray, known: np.ndarray, levels: list) -> np.ndarray:
    """Row of each key in `known` (whose last entry is a filler), or len(known) - 1."""
    missing = len(known) - 1
    out = np.full(len(keys), missing, dtype=np.int32)
    at = None
    for tab, factor, shift in levels:
        row = tab[(keys * factor) >> shift]
        hit = known[row] == keys
        if at is None:
            out[hit] = row[hit]
            at = np.flatnonzero(~hit)
        else:
            out[at[hit]] = row[hit]
            at = at[~hit]
        if not len(at):
            break
        keys = keys[~hit]
    return out


def build_model(langs: list[str], lang: np.ndarray, length: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict:
    """Code lengths of all known grams in all languages, longest matches resolved once.

    tables[k]: grams of k+1 bytes, bits of their last byte per language, and the escape bits
    per language when the gram is a context (0 where the language never saw the context).
    """
    tables: list[dict] = []
    if not len(gram):
        return {"langs": [], "tables": tables}
    for k in range(1, DEPTH + 1):
        mine = length == k
        keys, row = np.unique(gram[mine], return_inverse=True)
        count = np.zeros((len(keys), len(langs)))
        count[row, lang[mine]] = n[mine]
        tables.append({"keys": keys, "count": count})
    for k, t in enumerate(tables):
        keys, count = t["keys"], t["count"]
        # The context is what stands before the last byte; the lowest byte of a key is the last.
        parent = keys >> np.uint64(8)
        ctx, row = np.unique(parent, return_inverse=True)
        total, distinct = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
        np.add.at(total, row, count)
        np.add.at(distinct, row, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            seen = -np.log2(count / (total + distinct)[row])
        if k == 0:
            shorter = np.full((len(keys), len(langs)), 8.0)
            t["floor"] = (escape[0] + 8.0).astype(np.float32)
        else:
            below = tables[k - 1]
            suffix = keys & np.uint64((1 << (8 * k)) - 1)
            at = np.minimum(np.searchsorted(below["keys"], suffix), len(below["keys"]) - 1)
            shorter = below["bits"][at].astype(np.float64)
            escapes = np.zeros((len(below["keys"]) + 1, len(langs)), dtype=np.float32)
            where = np.searchsorted(below["keys"], ctx)
            where = np.where(below["keys"][np.minimum(where, len(below["keys"]) - 1)] == ctx, where, len(below["keys"]))
            escapes[where] = escape
            escapes[-1] = 0
            below["escape"] = escapes
        t["bits"] = np.where(count > 0, seen, escape[row] + shorter).astype(np.float32)
    for t in tables:
        t["levels"] = hash_levels(t["keys"])
        t["known"] = np.append(t["keys"], np.uint64((1 << 64) - 1))
        del t["keys"], t["count"]
    return {"langs": langs, "tables": tables}


def code_lengths(data: np.ndarray, model: dict) -> np.ndarray:
    """Bits of each byte after the first four, per language."""
    tables = model["tables"]
    out = np.zeros((len(data) - DEPTH + 1, len(model["langs"])), dtype=np.float32)
    at = np.arange(len(out))
    for length in range(DEPTH, 0, -1):
        t = tables[length - 1]
        window = grams(data, length)[DEPTH - length :] if length == DEPTH else grams_at(data, at, length)
        row = find(window, t["known"], t["levels"])
        hit = row < len(t["known"]) - 1
        if hit.all():
            out[at] += t["bits"][row]
            return out
        out[at[hit]] += t["bits"][row[hit]]
        at = at[~hit]
        if length > 1:
            below = tables[length - 2]
            context = find(grams_at(data, at - 1, length - 1), below["known"], below["levels"])
            out[at] += below["escape"][context]
        else:
            out[at] += t["floor"]
    return out


def grams_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Windows of `length` bytes that end at position `at` of the coded bytes."""
    end = at + DEPTH - 1
    out = data[end].astype(np.uint64)
    for k in range(1, length):
        out |= data[end - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and its posterior under equal priors; `und` and 0 for texts without a letter."""
    langs = model["langs"]
    spoken = [i for i, t in enumerate(texts) if t and langs and LETTER.search(t)]
    parts = [PAD + plain_bytes(texts[i]) for i in spoken]
    bits = np.zeros((len(spoken), len(langs)))
    if spoken:
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        # The pads between texts are coded as well, at the same cost whatever the text.
        start = np.cumsum([0, *map(len, parts)])
        for a in range(0, len(data) - DEPTH + 1, PIECE):
            piece = code_lengths(data[a : a + PIECE + DEPTH - 1], model)
            first = np.searchsorted(start, a + DEPTH - 1, side="right") - 1
            cuts = np.maximum(start[first:-1] - (a + DEPTH - 1), 0)
            cuts = cuts[cuts < len(piece)]
            bits[first : first + len(cuts)] += np.add.reduceat(piece, cuts, axis=0, dtype=np.float64)
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    for i, row in zip(spoken, bits, strict=True):
        best = int(np.argmin(row))
        pred[i] = langs[best]
        score[i] = float(1.0 / np.exp2(np.minimum(row[best] - row, 0.0)).sum())
    return pred, score


def train(rows: DataFrame, per_language: int = 400) -> dict:
    """Model of the languages of `rows` (text, lang), from about `per_language` whole texts each.

    The sample bounds the model: memory and broadcast don't grow with the corpus.
    """
    sample = bounded_sample(rows.filter("text IS NOT NULL"), F.col("lang"), per_language)
    counts = (
        sample.select("lang", "text").mapInArrow(_count_grams, "lang string, length int, gram long, n long")
        .groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).toArrow()
    )
    names = counts.column("lang").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    langs = sorted(names.dictionary.to_pylist())
    order = np.array([langs.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)
    column = lambda c: counts.column(c).to_numpy()
    lang = order[names.indices.to_numpy()] if langs else np.zeros(0, dtype=np.int64)
    return build_model(langs, lang, column("length"), column("gram").astype(np.uint64), column("n"))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs` (doc_id, text; other columns ignored).

    Null texts and texts without a letter are `und` with score 0, as is everything when the
    model knows no language. Repeated rows get equal answers; equal code lengths go to the
    first language by name. Empty input: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, posterior = predict(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(posterior, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Train on rows with a language outside the held-out fold (crc32 of doc_id mod 4 = 2), predict all."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.filter((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()), per_language)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
