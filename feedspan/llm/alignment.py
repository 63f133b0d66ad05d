"""Alignment of two tokenisations of a text by interval coalescing, and how often ids are linked.

The tokens of both sides are byte intervals. All intervals of a block of texts are sorted by start;
a group ends where a start reaches the running maximum of the ends. Tokens of a group are linked.

Both sides end a token before a run of spaces that follows other text, so texts are cut there into
units, each new unit is aligned once, and a text has the groups of its units one after another.

Counts of linked ids need every document and are needed in every document. Pairs are numbered inside
a block of documents, so only a block's distinct pairs meet the corpus counts, not every occurrence,
and the most frequent pair costs one row a block.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspan.llm.bpe import KEPT_WORDS, LONG_WORD, VOCABULARY, ByteBpe, TokenBytes, blocks, id_lists, shared_vocabulary
from feedspan.sources.storage import staged

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BLOCK = 1_000_000  # bytes of texts aligned together
WORDS = re.compile("[ ▁]+[^ ▁]*")  # a word with the spaces before it; the model takes U+2581 for one
UNITS = re.compile(r" +[^ ]*(?:(?<=[\s▁]) +[^ ]*)*")  # words up to a space that follows neither white space nor U+2581
SHORT_WORD = 64  # bytes of words that are merged in rounds; longer ones by the index of pairs
NO_RANK = np.iinfo(np.int32).max
BLOCK_ROWS, BLOCK_TOKENS = 500, 400_000  # documents and tokens whose pairs are numbered together, one document at least


class WordBpe(ByteBpe):
    """The byte-level encoder for many short words: in each round every word makes its merge of lowest rank."""

    def __init__(self, definition: bytes, younger: str = "", specials: bool = True) -> None:
        super().__init__(definition, younger, specials)
        first, second, self.made = np.array(self.rules, np.int64).reshape(-1, 3).T
        key = first << 32 | second
        self.rank_of = np.argsort(key)
        self.keys = key[self.rank_of]

    def _ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first << 32 | second
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        short = [w for w in words if len(w) <= SHORT_WORD]
        if not short or not len(self.keys):
            return super().merge(words)
        done = iter(self._rounds(short))
        rest = iter(super().merge([w for w in words if len(w) > SHORT_WORD]))
        return [next(done if len(w) <= SHORT_WORD else rest) for w in words]

    def _rounds(self, words: list[bytes]) -> list[bytes]:
        """Token ids (int32) of each word (none empty); a round costs as much as the words with a merge left are long."""
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol, last = np.array(self.byte_ids, np.int64)[raw], np.cumsum(size) - 1
        rank = np.append(self.byte_rank[raw[:-1], raw[1:]], -1)  # of each symbol with the next one of its word
        rank[rank < 0] = NO_RANK
        rank[last] = NO_RANK
        of, out = np.arange(len(words)), []  # the words at work; (word, size, symbols) of those that are done
        while len(of):
            start = np.cumsum(size) - size
            lowest = np.minimum.reduceat(rank, start)
            on = lowest < NO_RANK
            if not on.all():
                stays = np.repeat(on, size)
                out.append((of[~on], size[~on], symbol[~stays]))
                of, size, lowest, symbol, rank = of[on], size[on], lowest[on], symbol[stays], rank[stays]
                if not len(of):
                    break
                start = np.cumsum(size) - size
            word = np.repeat(np.arange(len(of)), size)
            at = np.flatnonzero(rank == lowest[word])
            at = at[np.diff(word[at], prepend=-1) > 0]  # the leftmost of each word
            symbol[at] = self.made[lowest]
            end = at + 2 == start + size  # the pair was the word's last
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, rank = symbol[stays], rank[stays]
            at = at - np.arange(len(at))
            size = size - 1
            start = start - np.arange(len(of))
            rank[at] = np.where(end, NO_RANK, self._ranks(symbol[at], symbol[np.minimum(at + 1, len(symbol) - 1)]))
            prior = at[at > start]
            rank[prior - 1] = self._ranks(symbol[prior - 1], symbol[prior])
        of, size, symbol = (np.concatenate(c) for c in zip(*out, strict=True))
        flat, upto = symbol.astype(np.int32).tobytes(), (4 * np.cumsum(size)).tolist()
        made = [b""] * len(words)
        for w, x, y in zip(of.tolist(), [0, *upto], upto):
            made[w] = flat[x:y]
        return made


class PieceTokenizer:
    """A sentencepiece model: ids of texts, and the bytes of each id."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [
            bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode("utf-8")
            for i in range(self.model.get_piece_size())
        ]
        self.table = TokenBytes(self.pieces)
        # Where no piece holds a space after another character, no token reaches from a word into the next
        # word's spaces, and words are encoded one by one.
        self.by_word = not any(b" " in p.lstrip(b" ") for p in self.pieces) and self._keeps_spaces()
        self.space = self.model.piece_to_id("▁")
        self.known: dict[str, bytes] = {}  # ids as four bytes each
        self.older: dict[str, bytes] = {}

    def _keeps_spaces(self) -> bool:
        """Whether the model adds one space before a text and changes nothing else in it."""
        probe = " a  b\u3000\ufb01 e\u0301 "
        return b"".join(self.pieces[i] for i in self.model.encode(probe)) == f" {probe}".encode()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't remembered; those too long to be are returned."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        new, passing = [], {}
        for w in words.difference(self.known):
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                self.known[w] = ids
        for w, ids in zip(new, self.each(new), strict=True):
            (self.known if len(w) <= LONG_WORD else passing)[w] = array("i", ids).tobytes()
        return passing

    def each(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word; the space that the model adds is the first one before it."""
        ids = self.model.encode([w[1:] for w in words], num_threads=1)
        return [x if len(w) > 1 else [self.space] for w, x in zip(words, ids, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts one after another, and how many each has."""
        if not self.by_word:
            ids = self.model.encode(texts, num_threads=1)
            counts = np.array([len(x) for x in ids], np.int64)
            return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts
        split = [WORDS.findall(f" {t}") if t else [] for t in texts]
        passing = self._learn({w for words in split for w in words})
        known = self.known
        if passing:
            known = {w: passing.get(w) or known[w] for words in split for w in words}
        parts = [b"".join(map(known.__getitem__, words)) for words in split]
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)


def coalesce(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start, and the group of each in that order; groups touch, but don't overlap."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = start[order][1:] >= reach[:-1]
    return order, np.concatenate(([0], np.cumsum(breaks)))


def align_ids(
    a: np.ndarray, count_a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of texts whose tokens cover the same bytes on both sides.

    a and b: ids of all texts one after another; count_a: A tokens of each text. Returns the number of
    groups of each text and, for each group, its A tokens, B tokens and bytes.
    """
    if not len(a):
        return np.zeros(len(count_a), np.int64), *(np.empty(0, np.int64),) * 3
    length = np.concatenate((size_a[a], size_b[b]))
    n = len(a)
    end = np.concatenate((np.cumsum(length[:n]), np.cumsum(length[n:])))  # texts follow one another on one axis
    order, group = coalesce(end - length, end)
    side = order >= n
    n_groups = int(group[-1]) + 1
    n_a = np.bincount(group[~side], minlength=n_groups)
    n_b = np.bincount(group[side], minlength=n_groups)
    n_bytes = np.bincount(group[~side], weights=length[:n], minlength=n_groups).astype(np.int64)
    text = np.repeat(np.arange(len(count_a)), count_a)  # of each A token, which are in order of start
    first = np.cumsum(n_a) - n_a
    return np.bincount(text[first], minlength=len(count_a)), n_a, n_b, n_bytes


def _whole(side, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts are what their tokens join to."""
    joined, ends = side.table.join(ids, counts)
    if joined == b"".join(texts) and np.diff(ends).tolist() == list(map(len, texts)):
        return np.ones(len(texts), bool)
    return np.array([joined[x:y] == t for x, y, t in zip(ends, ends[1:], texts, strict=False)], bool)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _places(sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where the values of the chosen lists stand among the values of all lists, which follow one another."""
    length = sizes[chosen]
    ends = np.cumsum(length)
    return np.repeat((np.cumsum(sizes) - sizes)[chosen] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of values; counts: values of each run."""
    upto, ends = np.concatenate(([0], np.cumsum(values))), np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


class Aligned(NamedTuple):
    """Tokens and groups of units one after another; a unit that isn't what its tokens join to has none."""

    n_a: np.ndarray  # tokens and groups of each unit
    n_b: np.ndarray
    n_groups: np.ndarray
    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray  # tokens and bytes of each group
    group_b: np.ndarray
    group_bytes: np.ndarray

    def take(self, chosen: np.ndarray) -> Aligned:
        group = _places(self.n_groups, chosen)
        return Aligned(
            self.n_a[chosen], self.n_b[chosen], self.n_groups[chosen], self.a[_places(self.n_a, chosen)],
            self.b[_places(self.n_b, chosen)], self.group_a[group], self.group_b[group], self.group_bytes[group])

    def and_then(self, more: Aligned) -> Aligned:
        return Aligned(*map(np.concatenate, zip(self, more, strict=True)))


NOTHING = Aligned(*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.int32)] * 5)


class Aligner:
    """Both encoders, and the units a task remembers."""

    def __init__(self, vocabulary: tuple[bytes, str], pieces: bytes) -> None:
        self.left, self.right = WordBpe(*vocabulary, specials=False), PieceTokenizer(pieces)
        self.known: dict[str, int] = {}  # unit -> its number in `aligned`
        self.aligned = NOTHING
        self.older: tuple[dict[str, int], Aligned] = {}, NOTHING

    def _encoded(self, units: list[str], raw: list[bytes], joined: int) -> list[tuple]:
        """Both sides' encoder, ids, and number of ids of each unit; the first `joined` don't end in white space."""
        ids, counts = self.left.encode(["".join(units[:joined]), *units[joined:]])
        ends = np.cumsum(np.fromiter(map(len, raw[:joined]), np.int64, joined))
        upto = np.searchsorted(np.cumsum(self.left.table.lengths[ids[: counts[0]]]), ends, side="right")
        pieces = self.right.each(units)
        return [
            (self.left, ids, np.concatenate((np.diff(upto, prepend=0), counts[1:]))),
            (self.right, np.fromiter(chain.from_iterable(pieces), np.int32), np.array([len(x) for x in pieces], np.int64))]

    def _align(self, units: list[str], joined: int | None = None) -> Aligned:
        """Units, the first `joined` of them without white space at their end; without that number, whole texts."""
        raw = [u.encode("utf-8") for u in units]
        if joined is None:
            sides = [(self.left, *self.left.encode(units)), (self.right, *self.right.encode([u[1:] for u in units]))]
        else:
            sides = self._encoded(units, raw, joined)
        good = np.logical_and(*(_whole(*s, raw) for s in sides))
        (a, n_a), (b, n_b) = ((ids[np.repeat(good, n)], n * good) for _, ids, n in sides)
        n_groups, *groups = align_ids(a, n_a, b, self.left.table.lengths, self.right.table.lengths)
        return Aligned(n_a, n_b, n_groups, a, b, *(g.astype(np.int32) for g in groups))

    def _learn(self, units: set[str]) -> dict[str, int]:
        """Numbers of the units, none known, that are too long to be remembered; the others are in `known` afterwards."""
        old, aligned = self.older
        again = [u for u in units if u in old]
        found = aligned.take(np.array([old[u] for u in again], np.int64))
        new = units.difference(again)
        at_end = [u for u in new if u[-1].isspace()]
        new = [*new.difference(at_end), *at_end]
        n = len(self.aligned.n_a)
        self.aligned = self.aligned.and_then(found)
        if new:
            self.aligned = self.aligned.and_then(self._align(new, len(new) - len(at_end)))
        passing = {}
        for i, u in enumerate(chain(again, new), n):
            (self.known if len(u) <= LONG_WORD else passing)[u] = i
        return passing

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in `aligned` of the units of the texts one after another, and how many each has.

        They hold until the next call.
        """
        if len(self.known) > KEPT_WORDS:
            self.older, self.known, self.aligned = (self.known, self.aligned), {}, NOTHING
        spaced = [f" {t}" if t else "" for t in texts]
        if not self.right.by_word:
            return self._whole_texts(spaced)
        split = list(map(UNITS.findall, spaced))
        counts = np.array([len(units) for units in split], np.int64)
        flat = list(chain.from_iterable(split))
        numbers = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(numbers < 0)
        new = [flat[i] for i in missing.tolist()]
        passing = self._learn(set(new))
        numbers[missing] = [passing[u] if u in passing else self.known[u] for u in new]
        failed = _sums(self.aligned.n_a[numbers] == 0, counts) > 0
        if failed.any():  # only the whole text tells if its tokens join to it
            instead, _ = self._whole_texts([t for t, f in zip(spaced, failed.tolist(), strict=True) if f])
            first = (np.cumsum(counts) - counts)[failed]
            numbers[first] = instead
            stays = ~np.repeat(failed, counts)
            stays[first] = True
            numbers, counts = numbers[stays], np.where(failed, 1, counts)
        return numbers, counts

    def _whole_texts(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same with each text for one unit; these are not remembered."""
        some = [t for t in spaced if t]
        n = len(self.aligned.n_a)
        if some:
            self.aligned = self.aligned.and_then(self._align(some))
        return np.arange(n, n + len(some)), np.array([bool(t) for t in spaced], np.int64)

    def forget(self) -> None:
        """Drop what no remembered unit needs."""
        kept = np.fromiter(self.known.values(), np.int64, len(self.known))
        if len(kept) < len(self.aligned.n_a):
            self.aligned = self.aligned.take(kept)
            self.known = {u: i for i, u in enumerate(self.known)}


def _aligner(docs: DataFrame, vocabulary: str, pieces: str):
    """From batches of doc_id and text to their ids, the aligned units, the numbers of each text's units and how many it has."""
    shared = shared_vocabulary(docs, vocabulary)
    with open(pieces, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Aligned, np.ndarray, np.ndarray]]:
        aligner = Aligner(shared.value, model.value)
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK):
                part = batch.slice(lo, hi - lo)
                numbers, counts = aligner.numbers([t or "" for t in part.column(1).to_pylist()])
                yield part.column(0), aligner.aligned, numbers, counts
                aligner.forget()

    return align


def _tokens(blocks: Iterator[tuple[pa.Array, Aligned, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for ids, aligned, numbers, counts in blocks:
        x = aligned.take(numbers)
        n_a, n_b, n_groups = (_sums(n, counts) for n in (x.n_a, x.n_b, x.n_groups))
        yield pa.RecordBatch.from_arrays(
            [ids, id_lists(x.a, n_a), id_lists(x.b, n_b), *(_lists(g, n_groups, pa.int32()) for g in x[5:])],
            names=["doc_id", "a", "b", "group_a", "group_b", "group_bytes"])


def align_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """Tokens and groups of every row of `docs` (doc_id, text).

    Columns: doc_id, a and b (ids of a space and the text by the byte-level vocabulary, special strings
    as plain text; ids of the text by the piece model, which adds the space), and for each group in
    order the number of its A tokens, of its B tokens and of its bytes (group_a, group_b, group_bytes).
    Null and empty texts, and texts whose joined token bytes differ from a space and the text on
    either side, have empty arrays. Repeated rows give equal rows; other columns are ignored. Empty
    input: no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    align = _aligner(docs, vocabulary, pieces)
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _tokens(align(batches)),
        f"doc_id {id_type}, a array<int>, b array<int>, group_a array<int>, group_b array<int>, group_bytes array<int>")


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, A id, B id and number of occurrences of the links, distinct within each group."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    one = np.flatnonzero(n_a * n_b == 1)
    out = [(one, a[first_a[one]], b[first_b[one]], np.ones(len(one), np.int64))]
    some = np.flatnonzero((n_a * n_b > 1) & (n_a * n_b <= 256))
    if len(some):  # every A token of a group with every B token of it
        wide = n_a[some] * n_b[some]
        at = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        group = np.repeat(some, wide)
        out.append((group, a[first_a[group] + at // n_b[group]], b[first_b[group] + at % n_b[group]], np.ones(len(group), np.int64)))
    for g in np.flatnonzero(n_a * n_b > 256).tolist():
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        out.append((np.full(len(ids_a) * len(ids_b), g), np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)),
                    np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _written(
    a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, last: np.ndarray, words: list[str]
) -> list[str]:
    """Each token in group order with the sign that follows it: , inside a side, | between sides, ; between groups.

    `words` holds the ids met so far with their four signs; it grows with the largest id.
    """
    upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    place_a = np.arange(len(a)) + (upto_b - n_b)[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sign_a[upto_a - 1], sign_b[upto_b - 1] = 1, np.where(last, 3, 2)
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a], code[place_b] = a * 4 + sign_a, b * 4 + sign_b
    words += [f"{i}{sign}" for i in range(len(words) // 4, int(code.max()) // 4 + 1) for sign in (",", "|", ";", "")]
    return list(map(words.__getitem__, code.tolist()))


DOC_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _totals(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the times of each."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)


def _numbered(ids: pa.Array, aligned: Aligned, numbers: np.ndarray, counts: np.ndarray, block: int, words: list[str]) -> pa.RecordBatch:
    """Rows of documents with their links as numbers of the block's pairs; the last row holds those pairs.

    `aligned` has the units, `numbers` those of the documents one after another, `counts` how many each has.
    """
    rows = len(ids)
    met = np.zeros(len(aligned.n_a), bool)
    met[numbers] = True
    place = (np.cumsum(met) - 1)[numbers]  # of each unit of a document among the block's units
    units = aligned.take(np.flatnonzero(met))
    a, b = units.a.astype(np.int64), units.b.astype(np.int64)
    n_a, n_b = units.group_a.astype(np.int64), units.group_b.astype(np.int64)
    n_units = len(units.n_a)
    unit = np.repeat(np.arange(n_units), units.n_groups)  # of each group
    len_a, len_b, n_groups, links = (
        _sums(n[place], counts) for n in (units.n_a, units.n_b, units.n_groups, _sums(n_a * n_b, units.n_groups)))
    written = _written(a, b, n_a, n_b, np.diff(unit, append=n_units) > 0, words) if len(a) else []
    ends = np.cumsum(units.n_a + units.n_b).tolist()
    written = ["".join(written[x:y]) for x, y in zip([0, *ends], ends)]
    digests, lo, places = [], 0, place.tolist()
    for size, n in zip(counts.tolist(), len_a.tolist(), strict=True):
        text = ";".join(map(written.__getitem__, places[lo : lo + size]))
        digests.append(hashlib.sha256(text.encode()).hexdigest() if n else "")
        lo += size
    group, ids_a, ids_b, times = _links(a, b, n_a, n_b)
    order = np.argsort(unit[group], kind="stable")
    pair, number = np.unique(((ids_a << 32) | ids_b)[order], return_inverse=True)
    times, n_links = times[order], np.bincount(unit[group], minlength=n_units)
    key, repeats = _totals(np.repeat(np.arange(rows), counts) * max(1, n_units) + place, np.ones(len(place), np.int64))
    doc, place = np.divmod(key, max(1, n_units))
    at, doc = _places(n_links, place), np.repeat(doc, n_links[place])
    key, total = _totals(doc * max(1, len(pair)) + number[at], times[at] * np.repeat(repeats, n_links[place]))
    owner, number = np.divmod(key, max(1, len(pair)))
    n_pairs = np.bincount(owner, minlength=rows)
    last_row = np.array([len(pair)])
    sizes, none = np.concatenate((n_pairs, [0])), np.zeros(rows + 1, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * (rows + 1), pa.int64()), pa.array([False] * rows + [True]),
            pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
            *(pa.array([*x.tolist(), None], pa.int64()) for x in (len_a, len_b, n_groups, links)),
            pa.array([*digests, None], pa.string()),
            _lists(number, sizes, pa.int32()), _lists(total, sizes, pa.int64()),
            _lists(pair, np.concatenate((none[:rows], last_row)), pa.int64()),
            _lists(np.bincount(number, minlength=len(pair)), np.concatenate((none[:rows], last_row)), pa.int32()),
        ],
        names=["block", "is_block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs", "docs"],
    )


def _number_pairs(blocks: Iterator[tuple[pa.Array, Aligned, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    block, words = TaskContext.get().partitionId() << 32, []
    for ids, aligned, numbers, counts in blocks:
        tokens = _sums((aligned.n_a + aligned.n_b)[numbers], counts)
        ends = [0, *np.cumsum(counts).tolist()]
        lo = held = 0
        for i, n in enumerate([*tokens.tolist(), 0]):
            if i > lo and (i == len(ids) or i - lo >= BLOCK_ROWS or held + n > BLOCK_TOKENS):
                yield _numbered(ids.slice(lo, i - lo), aligned, numbers[ends[lo] : ends[i]], counts[lo:i], block, words)
                lo, held, block = i, 0, block + 1
            held += n


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _counted(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of one block, from the corpus counts of the block's pairs."""
    n, best = np.zeros(0, np.int64), np.zeros(0, bool)
    if counts.num_rows:
        pairs = counts.column("counts").combine_chunks().flatten()
        place = pairs.field("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        n[place], best[place] = pairs.field("n").to_numpy(), pairs.field("best").to_numpy(zero_copy_only=False)
    at, times = (docs.column(c).combine_chunks() for c in ("at", "times"))
    owner = np.repeat(np.arange(docs.num_rows), np.diff(at.offsets.to_numpy()))
    number, times = at.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy()
    count_sum, n_best = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    np.add.at(count_sum, owner, times * n[number])
    np.add.at(n_best, owner, times * best[number])
    made = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table([made[c] if c in made else docs.column(c) for c in RESULT], names=RESULT)


def link_counts(numbered: DataFrame) -> DataFrame:
    """Corpus counts of the id pairs: a pair's documents (n), and whether no pair of its A id has more (best)."""
    pairs = numbered.filter("is_block").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = pairs.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.docs").cast("long")).alias("n"))
    counts = staged(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """Per row of `docs`: sizes of its alignment, sums of corpus counts over its links, and a hash of its groups.

    A link is an A and a B token occurrence of one group; the count of its id pair is the number of
    rows that hold the pair linked (a repeated row counts again). n_best: links whose count is the
    highest of their A id, ties included; count_sum: counts summed over links. Rows without tokens
    (see `align_tokens`) have zeros and an empty hash.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    align = _aligner(docs, vocabulary, pieces)
    # Tokens are numbered where they are made: only the numbers of a document's pairs leave the task.
    numbered = staged(docs.select("doc_id", "text").mapInArrow(
        lambda batches: _number_pairs(align(batches)), f"block long, is_block boolean, doc_id {id_type}, {DOC_COLUMNS}, "
        "at array<int>, times array<long>, pairs array<long>, docs array<int>"), "numbered-pairs")
    wanted = numbered.filter("is_block").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    looked_up = wanted.join(link_counts(numbered), "pair").groupBy("of_block").agg(
        F.collect_list(F.struct("place", "n", "best")).alias("counts"))
    rows = numbered.filter("NOT is_block").drop("is_block", "pairs", "docs")
    return rows.groupBy("block").cogroup(looked_up.groupBy("of_block")).applyInArrow(
        _counted, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
