"""Document quality from a linear-chain conditional random field over lines.

Every line has two states, good and bad. Emission weights see features of the line and of its
neighbours; transition weights tie neighbouring states. Forward-backward gives each line's
probability to be bad, and the length-weighted mean of these is mapped to the probability that
the document is good. Labels exist per document only, so lines of bad documents are relabelled
once by a chain-free model before the field is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspan.llm.common import fold, labelled_sample

ALL = bytes(range(256))
NOT_UPPER = bytes(c for c in ALL if not 65 <= c <= 90)
NOT_LOWER = bytes(c for c in ALL if not (97 <= c <= 122 or c > 127))
NOT_DIGIT = bytes(c for c in ALL if not 48 <= c <= 57)
NOT_SYMBOL = bytes(c for c in ALL if chr(c) not in "#*$%&|<>{}[]=_~^\\@/+")
NOT_SHOUT = bytes(c for c in ALL if chr(c) not in "!?")
FEATURES = (
    "log words", "short", "upper", "mostly upper", "digits", "symbols", "many symbols", "shouts", "many shouts",
    "distinct words", "few distinct", "repeats", "many repeats", "word length", "long words", "ends well", "seen before",
    "first", "no letters",
)
WIDTH = 3 * len(FEATURES) + 1  # the line, the one before, the one after, a constant
CHAIN = 64  # lines of a training chain; longer documents give several


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Base features and byte length of each line that holds a word; an empty text is one empty line."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = sum(map(len, words))
        upper, lower = len(line.translate(None, NOT_UPPER)), len(line.translate(None, NOT_LOWER))
        digits, symbols = len(line.translate(None, NOT_DIGIT)), len(line.translate(None, NOT_SYMBOL))
        shouts = len(line.translate(None, NOT_SHOUT))
        distinct, again = len(set(words)) / n, sum(map(eq, words, words[1:])) / n
        up = upper / max(1, upper + lower)
        rows.append((
            np.log1p(n) / 5, n < 4, up, up > 0.5, digits / size, min(2.0, symbols / n), symbols > 0.5 * n,
            min(2.0, shouts / n), shouts > 0.5 * n, distinct, distinct < 0.4, again, again > 0.3,
            min(3.0, size / n / 8), size > 12 * n, words[-1][-1:] in (b".", b"!", b"?", b'"', b")"), line in seen,
            not rows, not upper + lower,
        ))
        sizes.append(size)
        seen.add(line)
    if not rows:
        return np.zeros((1, len(FEATURES)), dtype=np.float32), np.ones(1)
    return np.array(rows, dtype=np.float32), np.array(sizes, dtype=np.float64)


def with_neighbours(base: np.ndarray) -> np.ndarray:
    out = np.zeros((len(base), WIDTH), dtype=np.float32)
    k = len(FEATURES)
    out[:, :k] = base
    out[1:, k : 2 * k] = base[:-1]
    out[:-1, 2 * k : 3 * k] = base[1:]
    out[:, -1] = 1
    return out


def marginals(emit: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains that lie one after another in `emit` (log odds of bad).

    Returns each line's probability of bad, the summed pair probabilities (2 x 2), and the log
    partition sum. Chains are stepped through together, longest first, each freed at its end.
    """
    order = np.argsort(-length, kind="stable")
    start = (np.cumsum(length) - length)[order]
    length = length[order]
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    local = np.stack([np.ones(len(emit)), np.exp(np.clip(emit, -30, 30))], 1)
    move = np.exp(trans)
    fwd, bwd, scale = np.zeros_like(local), np.ones_like(local), np.zeros(len(emit))
    for t, n in enumerate(alive):
        at = start[:n] + t
        a = local[at] * ((fwd[at - 1] @ move) if t else 1.0)
        scale[at] = a.sum(1)
        fwd[at] = a / scale[at, None]
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        b = (local[at] * bwd[at]) @ move.T
        bwd[at - 1] = b / scale[at, None]
    post = fwd * bwd
    post /= post.sum(1, keepdims=True)
    second = np.ones(len(emit), dtype=bool)
    second[start] = False
    at = np.flatnonzero(second)
    pairs = (fwd[at - 1].T @ (local[at] * bwd[at] / scale[at, None])) * move
    return post[:, 1], pairs, float(np.log(scale).sum())


def adam(gradient, size: int, steps: int, rate: float = 0.1) -> np.ndarray:
    """Maximise by Adam from zero; `gradient` maps a parameter vector to its gradient."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, decay: float = 1e-4) -> np.ndarray:
    total = weight.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        return x.T @ (weight * (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) / total - decay * w

    return adam(gradient, x.shape[1], steps)


def summary(post: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per document: length-weighted share of bad text in three shapes, a constant, and log size."""
    cuts = np.cumsum(length) - length
    total = np.add.reduceat(size, cuts)
    share = np.add.reduceat(post * size, cuts) / total
    clipped = np.clip(share, 0.005, 0.995)
    return np.stack([share, np.sqrt(share), np.log(clipped / (1 - clipped)) / 5, np.ones(len(total)), np.log1p(total) / 10], 1)


def train_model(docs: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 80) -> dict:
    """docs: (quality label, base features, line sizes). An empty list gives a model that knows nothing."""
    if not docs:
        return {"w": np.zeros(WIDTH), "trans": np.zeros((2, 2)), "map": np.zeros(5)}
    label = np.array([q for q, _, _ in docs])
    x = np.concatenate([with_neighbours(b) for _, b, _ in docs])
    size = np.concatenate([s for *_, s in docs])
    length = np.array([len(s) for *_, s in docs])
    bad = np.repeat(1.0 - label, length)
    share = np.repeat(1.0 / length, length)  # every document counts alike
    # Relabel: in a bad document only lines that look bad on their own stay bad, the worst one always.
    first = 1 / (1 + np.exp(-np.clip(x @ logistic(x, bad, share), -30, 30)))
    cuts = np.cumsum(length) - length
    worst = np.repeat(np.maximum.reduceat(first, cuts), length)
    target = bad * ((first >= 0.5) | (first >= worst))

    chains = np.concatenate([np.diff([*range(0, n, CHAIN), n]) for n in length])
    ends = np.cumsum(chains)
    inner = np.ones(len(x), dtype=bool)
    inner[ends - chains] = False
    at, seen = np.flatnonzero(inner), np.zeros((2, 2))
    np.add.at(seen, (target[at - 1].astype(int), target[at].astype(int)), 1)

    def gradient(p: np.ndarray) -> np.ndarray:
        post, pairs, _ = marginals(x @ p[:WIDTH], chains, p[WIDTH:].reshape(2, 2))
        g = np.concatenate([x.T @ (target - post), (seen - pairs).ravel()]) / len(x)
        return g - 1e-4 * p

    p = adam(gradient, WIDTH + 4, steps)
    w, trans = p[:WIDTH], p[WIDTH:].reshape(2, 2)
    post, _, _ = marginals(x @ w, length, trans)
    return {"w": w, "trans": trans, "map": logistic(summary(post, size, length), label.astype(float), np.ones(len(label)))}


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    """Probability that each text is good."""
    if not texts:
        return np.zeros(0)
    parts = [line_features(t) for t in texts]
    length = np.array([len(s) for _, s in parts])
    emit = np.concatenate([with_neighbours(b) @ model["w"] for b, _ in parts])
    post, _, _ = marginals(emit, length, model["trans"])
    z = summary(post, np.concatenate([s for _, s in parts]), length) @ model["map"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [line_features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([b.tobytes() for b, _ in parts], pa.binary()),
             pa.array([s.tobytes() for _, s in parts], pa.binary())],
            names=["quality", "features", "sizes"],
        )


def train(docs: DataFrame, labels: DataFrame, per_label: int) -> dict:
    """Fit on about `per_label` whole texts a label, outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", per_label, fold(F.col("doc_id"), 5) != 0)
    lines = sample.select("quality", "text").mapInArrow(
        _featurise, "quality int, features binary, sizes binary").collect()
    return train_model(sorted((
        (r["quality"], np.frombuffer(r["features"], dtype=np.float32).reshape(-1, len(FEATURES)),
         np.frombuffer(r["sizes"], dtype=np.float64))
        for r in lines
    ), key=lambda d: (d[0], len(d[2]), d[1].tobytes())))


def scorer(docs: DataFrame, model: dict) -> Column:
    """A column with the score of `text`, for a plan over `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts.to_pylist(), shared.value))

    return score(F.col("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = 1000) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row of `docs` (doc_id, text).

    Trained on labelled rows outside the held-out fold (crc32 of doc_id mod 5 = 0). Null and empty
    texts are scored as one empty line. Without labels every score is 0.5. Repeated rows get equal
    scores. Other columns are ignored. Empty input: no rows.
    """
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, scorer(docs, train(docs, labels, per_label)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, per_label: int = 1000) -> DataFrame:
    """Rows of `docs` whose score is at least 0.3, with all their columns."""
    return docs.filter(scorer(docs, train(docs, labels, per_label)) >= 0.3)
