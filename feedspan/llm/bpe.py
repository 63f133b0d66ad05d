"""Byte-level BPE by an index of pair occurrences, and decoding by the table of token bytes.

The distinct new words of a block of texts form one row of symbols. The index maps each pair that a
merge names to its positions there. Merges are applied in ascending rank, each to all its positions
at once; the pairs that appear beside a merged symbol join their own lists. No merge makes a pair of
lower rank than its own (checked when the vocabulary is read), so one pass over the ranks is enough.
"""

from __future__ import annotations

import functools
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BLOCK = 1_000_000  # bytes of texts that are encoded, or decoded, together
INDEXED = 500_000  # bytes of words whose pairs are indexed together, one word at least
KEPT_WORDS = 100_000  # words whose tokens a task remembers, and as many of before
LONG_WORD = 200  # longer words are not remembered

# The word pattern of the vocabulary, with the classes of letters and numbers left open.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{both}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for the bytes: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if chr(b) not in table):
        table[chr(256 + n)] = b
    return table


@functools.lru_cache(maxsize=4)
def younger_characters(definition: bytes) -> str:
    """Letters and numbers of newer Unicode tables that the vocabulary's own library takes for symbols."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_buffer(definition).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    found = []
    for kind, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        for c in regex.findall(kind, every):
            if unicodedata.category(c) == "Cn" and len(split(before + c)) > 1:
                found.append(c)
    return "".join(found)


def _ranges(chars: str) -> str:
    """The inside of a character class that holds these characters."""
    codes = np.unique([ord(c) for c in chars])
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs)


class TokenBytes:
    """The bytes of each token id, joined for many ids at once."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.lengths = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joined bytes of all ids, and where each text begins and the last ends; counts: ids of each text."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.starts[ids] - (ends - length), length) + np.arange(ends[-1] if len(ids) else 0)
        return self.bytes[at].tobytes(), np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]


class ByteBpe:
    """Encoder and decoder for one vocabulary file; `specials` says if special strings become their ids."""

    def __init__(self, definition: bytes, younger: str = "", specials: bool = True) -> None:
        spec = json.loads(definition)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = (
            model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
            and not spec["normalizer"] and not any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not plain:
            raise ValueError("the vocabulary is not a plain byte-level BPE")
        byte_of, ids = byte_alphabet(), model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in ids.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.pieces[i] = token.encode("utf-8")
        self.byte_ids = [0] * 256
        for c, b in byte_of.items():
            self.byte_ids[b] = ids[c]
        self.rules: list[tuple[int, int, int]] = []
        self.right: dict[int, dict[int, int]] = {}  # symbol -> symbol after it -> rank of the pair
        self.left: dict[int, dict[int, int]] = {}  # symbol -> symbol before it -> rank of the pair
        self.byte_rank = np.full((256, 256), -1, np.int32)
        bytes_by_id = {i: b for b, i in enumerate(self.byte_ids)}
        born = set(self.byte_ids)
        for rank, merge in enumerate(model["merges"]):
            first, second = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = ids[first], ids[second], ids[first + second]
            if c in born or a not in born or b not in born:
                raise ValueError(f"merge {rank} uses a token that a later merge makes, or makes one anew")
            born.add(c)
            self.rules.append((a, b, c))
            self.right.setdefault(a, {})[b] = rank
            self.left.setdefault(b, {})[a] = rank
            if a in bytes_by_id and b in bytes_by_id:
                self.byte_rank[bytes_by_id[a], bytes_by_id[b]] = rank
        self.specials = added if specials else {}
        marks = sorted(self.specials, key=len, reverse=True)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.words = regex.compile(PATTERN.format(letter=r"\p{L}", number=r"\p{N}", both=r"\p{L}\p{N}"))
        self.younger = frozenset(younger)
        if younger:
            odd = _ranges(younger)
            self.wide = regex.compile(rf"[\U{ord(min(younger)):08x}-\U0010ffff]")
            letter, number = rf"[\p{{L}}--[{odd}]]", rf"[\p{{N}}--[{odd}]]"
            self.strict = regex.compile(PATTERN.format(letter=letter, number=number, both=letter + number), regex.V1)
        self.known: dict[str, bytes] = {}  # ids as four bytes each
        self.older: dict[str, bytes] = {}
        self.table = TokenBytes(self.pieces)

    def split(self, text: str) -> list[str]:
        """The words of a text; special strings stay whole."""
        if self.mark is None or not self.mark.search(text):
            return self._split(text)
        return [w for part in self.mark.split(text) for w in ([part] if part in self.specials else self._split(part))]

    def _split(self, text: str) -> list[str]:
        odd = self.younger and not text.isascii() and self.wide.search(text) and not self.younger.isdisjoint(text)
        return (self.strict if odd else self.words).findall(text)

    def _first_places(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """Rank of each pair of neighbouring bytes in a word -> its positions, ascending."""
        ranks = self.byte_rank[raw[:-1], raw[1:]]
        ranks[ends[:-1] - 1] = -1
        places = np.flatnonzero(ranks >= 0)
        ranks = ranks[places]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        return {int(r): p.tolist() for r, p in zip(ranks[starts], np.split(places, starts[1:]), strict=True)} if len(starts) else {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids (int32) of each word (none empty), by the index of pair occurrences over all of them."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        symbols = np.array(self.byte_ids)[raw].tolist()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends[:-1]] = -1, -1  # -1 stands at both ends of a word
        after, before = after.tolist(), before.tolist()
        where = self._first_places(raw, ends)
        active = sorted(where)
        none: dict[int, int] = {}
        push, rules, right, left_of = heapq.heappush, self.rules, self.right, self.left
        while active:
            r = heapq.heappop(active)
            a, b, c = rules[r]
            follows, precedes = right.get(c, none), left_of.get(c, none)
            places = where.pop(r)
            if a == b:
                places.sort()  # occurrences may overlap: from the left
            for i in places:
                j = after[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue  # a lower rank took one of the two
                symbols[i], symbols[j] = c, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    s = symbols[k]
                    if s in follows:
                        s = follows[s]
                        if s in where:
                            where[s].append(i)
                        else:
                            where[s] = [i]
                            push(active, s)
                h = before[i]
                if h >= 0:
                    s = symbols[h]
                    if s in precedes:
                        s = precedes[s]
                        if s in where:
                            where[s].append(h)
                        else:
                            where[s] = [h]
                            push(active, s)
        left = np.array(symbols)
        stays = left >= 0
        upto = np.cumsum(stays)[ends - 1].tolist()
        flat = left[stays].astype(np.int32).tobytes()
        return [flat[4 * x : 4 * y] for x, y in zip([0, *upto], upto)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't remembered; those too long to be are returned."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        passing = {w: np.int32(i).tobytes() for w, i in self.specials.items() if w in words}
        new, held = [], 0
        for w in words.difference(self.known, passing):
            ids = self.older.get(w)
            if ids is not None:
                self.known[w] = ids
                continue
            new.append(w)
            held += len(w)
            if held >= INDEXED:
                self._keep(new, passing)
                new, held = [], 0
        self._keep(new, passing)
        return passing

    def _keep(self, new: list[str], passing: dict[str, bytes]) -> None:
        for w, ids in zip(new, self.merge([w.encode("utf-8") for w in new]), strict=True):
            (self.known if len(w) <= LONG_WORD else passing)[w] = ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (int32) of the texts one after another, and how many each has."""
        split = [self.split(t) for t in texts]
        passing = self._learn({w for words in split for w in words})
        known = self.known
        if passing:
            known = {w: passing.get(w) or known[w] for words in split for w in words}
        parts = [b"".join(map(known.__getitem__, words)) for words in split]
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of token ids; bytes that aren't UTF-8 become U+FFFD."""
        raw, offsets = self.table.join(ids, counts)
        column = pa.Array.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        try:
            return column.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(offsets, offsets[1:])], pa.string())


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `size` bytes of text, or `size` list entries, one row at least."""
    lengths = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0)
    lo = held = 0
    for i, n in enumerate(lengths.to_pylist()):
        if i > lo and held + n > size:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(column) > lo:
        yield lo, len(column)


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def shared_vocabulary(docs: DataFrame, path: str):
    """The vocabulary file (a few MB, whatever the corpus), sent to each executor once."""
    with open(path, "rb") as f:
        definition = f.read()
    return docs.sparkSession.sparkContext.broadcast((definition, younger_characters(definition)))


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, specials: bool = True) -> DataFrame:
    """doc_id and ids (array<int>) of every row of `docs` (doc_id, text).

    Special strings in a text become their own ids unless `specials` is false. Null and empty texts
    have no ids. A text is encoded whole, whatever its length. Repeated rows give equal rows; other
    columns are ignored. Empty input: no rows.
    """
    shared = shared_vocabulary(docs, vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*shared.value, specials)
        for batch in batches:
            for lo, hi in blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists(*ids)], names=["doc_id", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {id_type}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of `encoded` (doc_id, ids) with `decoded`, the text of their ids; null ids are none."""
    shared = shared_vocabulary(encoded, vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*shared.value)
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK // 4):
                part = batch.slice(lo, hi - lo)
                ids = part.column(1)
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                texts = bpe.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "ids", "decoded"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(apply, f"doc_id {id_type}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text decoded from them."""
    return bpe_decode(bpe_encode(docs, vocabulary), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
