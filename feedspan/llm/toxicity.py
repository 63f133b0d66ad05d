"""Toxicity from a learned lexicon: Levenshtein automata over its trie, and the context of each hit.

Terms are words that occur far more often in toxic training documents than in clean ones; stems
are beginnings that several terms share and no clean word has. The automata of all terms run
together over the trie as one deterministic machine, built state by state as words need it. A
hit weighs more where a person is addressed or other hits are near, and less in quotation.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.llm.common import fold, labelled_sample
from feedspan.llm.crf_quality import logistic

TOKEN = re.compile(r"\w+")
EXACT, STEM, FUZZY = 0, 1, 2
WINDOW = 6  # words on either side of a hit
KEPT_WORDS = 300_000  # words remembered as harmless per task before the memory starts anew

# Words of address and of reporting in the languages at hand.
ADDRESS = frozenset("you your you're youre ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti su".split())
REPORT = frozenset(
    "said says called calls wrote writes quoted quote quotes word words term slur insult sagte nannte schrieb wort zitat "
    "dit appelé écrit mot terme citation dijo llamó escribió palabra término cita".split()
)
OPEN, CLOSE = "\"“„«‹'‘", "\"”“»›'’"


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class TermMachine:
    """Accepts words within each term's edit distance, and words that begin with a stem."""

    def __init__(self, terms: list[str], stems: list[str], exceptions: frozenset[str] = frozenset()) -> None:
        self.exact, self.exceptions = frozenset(terms), exceptions
        self.children: list[dict[str, int]] = [{}]
        self.edits, self.final, self.stem = [0], [-1], [False]
        for word, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            node, edits = 0, 0 if is_stem else allowed_edits(word)
            self.edits[0] = max(self.edits[0], edits)
            for ch in word:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                    self.final.append(-1)
                    self.stem.append(False)
                node = self.children[node][ch]
                self.edits[node] = max(self.edits[node], edits)
            if is_stem:
                self.stem[node] = True
            else:
                self.final[node] = edits
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []  # -1, or the kind of the best hit that ends here
        self.start = self._state({0: 0})

    def _state(self, costs: dict[int, int]) -> int:
        """Number of a set of (node, edits) after letters of terms that the word leaves out; -1 if empty."""
        work = list(costs.items())
        while work:
            node, cost = work.pop()
            if costs[node] < cost:
                continue
            for child in self.children[node].values():
                if cost + 1 <= self.edits[child] and cost + 1 < costs.get(child, 99):
                    costs[child] = cost + 1
                    work.append((child, cost + 1))
        key = tuple(sorted(costs.items()))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            stem = any(self.stem[n] and c == 0 for n, c in key)
            fuzzy = any(self.final[n] >= c for n, c in key)
            self.accepts.append(STEM if stem else FUZZY if fuzzy else -1)
        return self.number[key]

    def _move(self, state: int, ch: str) -> int:
        costs: dict[int, int] = {}

        def reach(node: int, cost: int) -> None:
            if cost <= self.edits[node] and cost < costs.get(node, 99):
                costs[node] = cost

        for node, cost in self.states[state]:
            reach(node, cost + 1)  # a letter too many
            for letter, child in self.children[node].items():
                if letter == ch:
                    if cost < costs.get(child, 99):
                        costs[child] = cost
                else:
                    reach(child, cost + 1)
        return self._state(costs)

    def match(self, word: str) -> int:
        """EXACT, STEM or FUZZY, or -1."""
        if word in self.exact:
            return EXACT
        state = self.start
        for ch in word:
            nxt = self.moves[state].get(ch)
            if nxt is None:
                nxt = self.moves[state][ch] = self._move(state, ch)
            if nxt < 0:
                return -1
            state = nxt
            if self.accepts[state] == STEM:
                return STEM
        found = self.accepts[state]
        return -1 if found == FUZZY and word in self.exceptions else found


FEATURES = 7


def hit_weight(text: str, a: int, b: int, before: list[str], after: list[str], near: int) -> float:
    """How much a hit at text[a:b] counts, by the words around it and by quotation marks."""
    left, right = text[max(0, a - 60) : a], text[b : b + 60]
    quoted = False
    for mark, end in zip(OPEN, CLOSE, strict=True):
        i = left.rfind(mark)
        if i >= 0 and (mark != "'" or not left[i + 1 : i + 2].isspace()) and end in right and end not in left[i + 1 :]:
            quoted = quoted or left[: i].count(mark) % 2 == 0 or mark != end
    reported = not REPORT.isdisjoint(before[-4:])
    addressed = not ADDRESS.isdisjoint(before) or not ADDRESS.isdisjoint(after)
    return max(0.1, (1.0 + 0.5 * addressed + 0.25 * min(near, 4)) * (0.25 if quoted else 1.0) * (0.5 if reported else 1.0))


class Scorer:
    """Turns texts into features; remembers what it has learned about words, up to a bound."""

    def __init__(self, model: dict) -> None:
        self.machine = TermMachine(model["terms"], model["stems"], model["exceptions"])
        self.harmless: set[str] = set()
        self.hits: dict[str, int] = {}

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = TOKEN.findall(low)
        distinct = set(words)
        if len(self.harmless) > KEPT_WORDS:
            self.harmless.clear()
            self.hits.clear()
        for w in distinct.difference(self.harmless):
            if w not in self.hits:
                kind = self.machine.match(w)
                if kind < 0:
                    self.harmless.add(w)
                else:
                    self.hits[w] = kind
        if self.hits.keys().isdisjoint(distinct):
            return [0.0] * (FEATURES - 1) + [1.0]
        spans = [m.span() for m in TOKEN.finditer(low)]
        at = [i for i, w in enumerate(words) if w in self.hits]
        total = [0.0, 0.0, 0.0]
        place = np.array(at)
        near = np.searchsorted(place, place + WINDOW, side="right") - np.searchsorted(place, place - WINDOW) - 1
        for i, n in zip(at, near.tolist(), strict=True):
            total[self.hits[words[i]]] += hit_weight(
                low, *spans[i], words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW], n)
        weighed = sum(total)
        return [*np.log1p(total).tolist(), min(weighed, 1.0), min(10.0, 100 * weighed / len(words)) / 10,
                float(near.max()) / 4 if len(near) else 0.0, 1.0]


def score_texts(texts: list[str | None], scorer: Scorer, weights: np.ndarray | None) -> np.ndarray:
    if weights is None:
        return np.zeros(len(texts))
    x = np.array([scorer.features(t) for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, words and a fingerprint of each text: the least hash of its five-word runs, shared by near copies."""
    for batch in batches:
        prints, lists = [], []
        for text in batch.column(1).to_pylist():
            words = TOKEN.findall(text.lower())
            runs = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
            prints.append(min(zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in runs))
            lists.append(sorted({w for w in words if len(w) > 2 and not w.isdigit()}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64()), pa.array(lists, pa.list_(pa.string()))],
            names=["toxic", "print", "words"],
        )


def pick_terms(words: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict:
    """Lexicon from (word, toxic documents, clean documents).

    A term occurs in three toxic documents at least and half a percent of them, at twenty times its
    rate in clean ones.
    """
    least = max(3, 0.005 * n_toxic)
    terms = sorted(
        w for w, t, c in words
        if t >= least and (t + 0.5) / (n_toxic + 1) >= 20 * (c + 0.5) / (n_clean + 1)
    )
    known = set(terms)
    clean = [w for w, _, c in words if c and w not in known]
    begins_clean = {w[:k] for w in clean for k in range(4, min(len(w), 12) + 1)}
    shared = Counter(w[:k] for w in terms for k in range(4, min(len(w), 12)))
    stems: list[str] = []
    for stem, n in sorted(shared.items(), key=lambda x: (len(x[0]), x[0])):
        if n >= 4 and stem not in begins_clean and not stem.startswith(tuple(stems)):
            stems.append(stem)
    machine = TermMachine(terms, stems)
    exceptions = frozenset(w for w in clean if machine.match(w) == FUZZY)
    return {"terms": terms, "stems": stems, "exceptions": exceptions}


def train(docs: DataFrame, labels: DataFrame, per_label: int) -> dict:
    """Lexicon and weights from about `per_label` whole texts a label, outside the held-out fold.

    Near copies among them count once, else the rare words of a copied text would look toxic.
    """
    sample = labelled_sample(docs, labels, "toxic", per_label, fold(F.col("doc_id"), 4) != 2).select("toxic", "text")
    listed = sample.mapInArrow(_distinct_words, "toxic int, print long, words array<string>").dropDuplicates(
        ["toxic", "print"])
    # An empty word in every document: its counts are those of the documents.
    words = listed.select("toxic", F.explode(F.concat(F.array(F.lit("")), "words")).alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).toArrow()
    table = list(zip(*(counts.column(c).to_pylist() for c in ("word", "t", "c")), strict=True))
    n_toxic, n_clean = next(((t, c) for w, t, c in table if not w), (0, 0))
    model = pick_terms([x for x in table if x[0]], n_toxic, n_clean)
    if not n_toxic + n_clean:
        return {**model, "weights": None}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sample.mapInArrow(measure, "toxic int, x array<double>").toArrow()
    y = seen.column("toxic").to_numpy().astype(float)
    x = np.array(seen.column("x").to_pylist()).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return {**model, "weights": logistic(x[order], y[order], np.ones(len(y)), steps=300)}


def scored(docs: DataFrame, model: dict) -> Column:
    """A column with the toxicity of `text`, for a plan over `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array(score_texts(texts.to_pylist(), scorer, shared.value["weights"]))

    return score(F.col("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_label: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row of `docs` (doc_id, text).

    Trained on labelled rows outside the held-out fold (crc32 of doc_id mod 4 = 2). Null and empty
    texts hold no hit and get the score of a text without hits. Without labels every score is 0.
    Repeated rows get equal scores. Other columns are ignored. Empty input: no rows.
    """
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    result = docs.select("doc_id", held_out.alias("held_out"), scored(docs, train(docs, labels, per_label)).alias("score"))
    return result.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_label: int = 4000) -> DataFrame:
    """Rows of `docs` whose score is below 0.3, with all their columns."""
    return docs.filter(scored(docs, train(docs, labels, per_label)) < 0.3)
