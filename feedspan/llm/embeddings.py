"""Near-duplicate embeddings by an inverted multi-index.

Each half of a vector has a codebook of its own; pairs of codewords form a grid of cells. The
multi-sequence traversal lists the cells nearest to a vector, and vectors that visit a common
cell are compared exactly. How many cells are visited is set by true pairs, those inside a
sample and those of some query vectors with all rows: the fewest that reach the target recall.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspan.llm.common import bounded_sample
from feedspan.llm.components import components
from feedspan.sources.storage import staged

log = logging.getLogger(__name__)

FIRST_VISITS = 16  # visits weighed at first; four times as many while they don't reach the target
FEW, SAFE_VISITS = 100, 8  # with fewer queries that have a pair, so many cells are visited at least
NEEDED = 0.9  # the recall that its lower bound must show
BLOCK = 1024  # vectors of a cell that one side of a comparison holds


def vectors(column: pa.ListArray) -> list[np.ndarray | None]:
    """Double vectors; None for null, empty, zero, and for null or non-finite components."""
    out: list[np.ndarray | None] = []
    for value in column:
        if not value.is_valid or value.values.null_count:
            out.append(None)
            continue
        v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            norm = np.sqrt((v * v).sum())
        out.append(v if len(v) and np.isfinite(norm) and norm > 0 else None)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spaced rows of the sorted sample; empty clusters keep their centre."""
    x = x[np.lexsort(x.T[:4])]
    centres = x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin(distances(x, centres), axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The n nearest cells of each row, in the order of the multi-sequence traversal.

    With both halves' codewords in ascending distance, the k-th cell of the traversal has ranks
    (a, b) with (a + 1) * (b + 1) <= k, so only those corners of the grid are weighed.
    """
    half = x.shape[1] // 2
    parts = (x[:, :half], x[:, half:])
    order, near = [], []
    for part, book in zip(parts, books, strict=True):
        d = distances(part, book)
        ranks = np.argsort(d, axis=1, kind="stable")[:, :n]
        order.append(ranks)
        near.append(np.take_along_axis(d, ranks, axis=1))
    corners = [(a, b) for a in range(order[0].shape[1]) for b in range(order[1].shape[1]) if (a + 1) * (b + 1) <= n]
    a, b = np.array(corners).T
    best = np.argsort(near[0][:, a] + near[1][:, b], axis=1, kind="stable")[:, :n]
    cells = order[0][:, a] * len(books[1]) + order[1][:, b]
    return np.take_along_axis(cells, best, axis=1).astype(np.int32)


def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many visits two rows need to meet, row by row; one more than there are if they don't."""
    out = np.full(len(a), a.shape[1] + 1)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            np.minimum(out, max(i, j) + 1, out=out, where=a[:, i] == b[:, j])
    return out


def lower_bound(share: float, n: int, z: float = 1.645) -> float:
    """Wilson's lower bound (95 %, one-sided) of a share seen in n trials."""
    if not n:
        return 0.0
    mid, spread = share + z * z / (2 * n), z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return float((mid - spread) / (1 + z * z / n))


def _query_pairs(queries: dict, least: float, thin: int = 16):
    """Pairs of the query vectors with all rows: dimension, query, visits needed, pairs.

    Of the rows of a batch near one query `thin` to twice as many are weighed for all of them.
    Rows equal to the query are left out: copies always link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, labels = vectors(batch.column(0)), batch.column(1).to_pylist()
            for size, (q, names, q_cells, books) in queries.items():
                mine = [i for i, v in enumerate(found) if v is not None and len(v) == size]
                for start in range(0, len(mine), BLOCK):
                    part = mine[start : start + BLOCK]
                    x = unit(np.stack([found[i] for i in part]))
                    own = np.array([labels[i] for i in part], dtype=object)
                    v, u = np.nonzero((q @ x.T >= least) & (names[:, None] == own[None, :]))
                    if not len(v):
                        continue
                    count = np.bincount(v, minlength=len(q))
                    place = np.arange(len(v)) - (np.cumsum(count) - count)[v]
                    kept = place % np.maximum(1, count // thin)[v] == 0
                    v, u = v[kept], u[kept]
                    weight = (count / np.maximum(1, np.bincount(v, minlength=len(q))))[v]
                    other = np.abs(x[u] - q[v]).max(axis=1) > 1e-12
                    v, u, weight = v[other], u[other], weight[other]
                    rows, back = np.unique(u, return_inverse=True)
                    cells = visits(x[rows], books, q_cells.shape[1]) if len(rows) else q_cells[:0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), size)), pa.array(v), pa.array(ranks(cells[back], q_cells[v])), pa.array(weight)],
                        names=["size", "query", "rank", "pairs"])

    return run


def recall(found: np.ndarray, visited: int) -> tuple[float, int]:
    """Least of the recall over pairs and the mean recall of a query, and the queries with a pair.

    found: query, visits needed, pairs.
    """
    queries, at = np.unique(found[:, 0], return_inverse=True)
    if not len(queries):
        return 1.0, 0
    total = np.bincount(at, found[:, 2])
    met = np.bincount(at, found[:, 2] * (found[:, 1] <= visited))
    return float(min(met.sum() / total.sum(), (met / total).mean())), len(queries)


def enough_visits(found: np.ndarray, most: int, target: float) -> int | None:
    """The fewest visits whose recall reaches the target and, with queries enough, whose bound shows what is needed."""
    for n in range(1, most + 1):
        share, queries = recall(found, n)
        if share >= target - 1e-9 and (queries < FEW or lower_bound(share, queries) >= NEEDED):
            return max(n, min(SAFE_VISITS, most)) if queries < FEW else n
    return None


def fit(rows: DataFrame, least: float, target: float = 1.0, sample: int = 8192, words: int = 64, queries: int = 1024) -> dict:
    """Index by dimension: codebooks of about `sample` vectors, and the number of visits.

    The visits reach the target over the pairs inside the sample and over those of `queries` of
    its vectors with all rows, which grow with the table as the groups do.
    """
    chosen = bounded_sample(rows.withColumnRenamed("vec_id", "doc_id"), F.lit(1), sample)
    taken = chosen.select("label", "embedding").toArrow()
    labels = np.array(taken.column("label").to_pylist(), dtype=object)
    all_vectors = vectors(taken.column("embedding").combine_chunks()) if taken.num_rows else []
    waiting, index, most = {}, {}, FIRST_VISITS
    for size in sorted({len(v) for v in all_vectors if v is not None and len(v) > 1}):
        mine = [i for i, v in enumerate(all_vectors) if v is not None and len(v) == size]
        x = unit(np.stack([all_vectors[i] for i in mine]))
        half, k = size // 2, max(1, min(words, len(mine) // 8))
        waiting[size] = x, labels[mine], (codebook(x[:, :half], k), codebook(x[:, half:], k))
    while waiting:
        asked = {}
        for size, (x, own, books) in waiting.items():
            some = np.random.default_rng(0).permutation(len(x))[:queries]
            asked[size] = x[some], own[some], visits(x[some], books, most), books
        seen = rows.select("embedding", "label").mapInArrow(
            _query_pairs(asked, least), "size long, query long, rank long, pairs double")
        pairs = seen.groupBy("size", "query", "rank").agg(F.sum("pairs").alias("pairs")).toPandas()
        for size, (x, own, books) in list(waiting.items()):
            found = pairs.loc[pairs["size"] == size, ["query", "rank", "pairs"]].to_numpy(dtype=np.float64)
            cells = visits(x, books, most)
            inside = np.zeros(cells.shape[1] + 2)
            for start in range(0, len(x), BLOCK):
                part = slice(start, start + BLOCK)
                a, b = np.nonzero((x[part] @ x.T >= least) & (own[part, None] == own[None, :]))
                a = a + start
                a, b = a[a < b], b[a < b]
                inside += np.bincount(ranks(cells[a], cells[b]), minlength=len(inside))
            met = np.cumsum(inside)
            sampled = int(np.flatnonzero(met >= target * inside.sum())[0])
            grid = len(books[0]) * len(books[1])
            n = enough_visits(found, cells.shape[1], target)
            if (n is None or sampled > cells.shape[1]) and cells.shape[1] < grid:
                continue  # more visits
            n = max(n or cells.shape[1], min(sampled, cells.shape[1]))
            share, asking = recall(found, n)
            log.warning(
                "%d dimensions: %d cells visited, recall %.4f (lower bound %.4f) over all rows for %d queries with a pair, "
                "%d pairs in the sample", size, n, share, lower_bound(share, asking), asking, int(inside.sum()))
            index[size] = (*books, n)
            del waiting[size]
        most *= 4
    return index


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least cell that both rows visit, or a number beyond all cells."""
    none = np.iinfo(np.int32).max
    out = np.full(len(a), none, dtype=np.int32)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            same = a[:, i] == b[:, j]
            out[same] = np.minimum(out[same], a[same, i])
    return out


def labels_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least index in the component of each of n nodes under the links (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _compare(least: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """Links of one block of a cell, or between two of its blocks."""
        cell, lo, hi = (k.as_py() for k in key[2:5])
        x = np.stack([np.frombuffer(v, dtype=np.float64) for v in group.column("vector").to_pylist()])
        norm = np.sqrt((x * x).sum(1))
        cells = np.stack([np.array(c, dtype=np.int32) for c in group.column("cells").to_pylist()])
        copies = group.column("copies").to_numpy()
        block = group.column("block").to_numpy()
        nodes = group.column("node").to_pylist()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links = np.zeros(len(x), dtype=np.int64)
        us, vs = [], []
        for start in range(0, len(left), 256):
            part = left[start : start + 256]
            near = x[part] @ x[right].T / (norm[part, None] * norm[None, right]) >= least
            u, v = np.nonzero(near)
            u, v = part[u], right[v]
            ahead = u < v if lo == hi else u != v
            u, v = u[ahead], v[ahead]
            # A pair that meets in several cells counts in the first of them.
            here = first_common(cells[u], cells[v]) == cell
            u, v = u[here], v[here]
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)])
        label = labels_of(u, v, len(x))
        keep = np.flatnonzero(links > 0)
        return pa.table({
            "node": pa.array([nodes[i] for i in keep], pa.binary()),
            "links": pa.array(links[keep]),
            "mate": pa.array([nodes[label[i]] for i in keep], pa.binary()),
        })

    return run


def embedding_duplicates(
    rows: DataFrame, least: float = 0.98, target: float = 1.0, sample: int = 8192
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `rows` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, their dimensions equal, and their cosine
    in double precision is at least `least`. Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do rows of a null label. Equal vectors of a label
    are one node with a number of copies, all linked with each other. Repeated rows count as other
    vectors. Other columns are ignored. Empty input: no rows. n_links counts the pairs found;
    every link counted is true, and `target` of the true pairs inside the sample, and of those that
    some of its vectors have in the whole table, share a visited cell; `fit` logs the recall.
    """
    rows = rows.select("vec_id", "embedding", "label")
    usable = rows.filter("label IS NOT NULL AND size(embedding) > 0")
    index = rows.sparkSession.sparkContext.broadcast(fit(usable, least, target, sample))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch.column(1))
            cells: list = [None] * len(found)
            for size in {len(v) for v in found if v is not None}:
                mine = [i for i, v in enumerate(found) if v is not None and len(v) == size]
                if size in index.value:
                    *books, n = index.value[size]
                    seen = visits(unit(np.stack([found[i] for i in mine])), books, n)
                else:
                    seen = np.zeros((len(mine), 1), dtype=np.int32)
                for i, c in zip(mine, seen.tolist(), strict=True):
                    cells[i] = c
            labels = batch.column(2).to_pylist()
            raw = [None if v is None else (v + 0.0).tobytes() for v in found]
            nodes = [
                None if r is None else hashlib.blake2b(repr(y).encode() + r, digest_size=16).digest()
                for r, y in zip(raw, labels, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(raw, pa.binary()),
                 pa.array(cells, pa.list_(pa.int32()))],
                names=["vec_id", "label", "node", "vector", "cells"],
            )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed = staged(usable.mapInArrow(
        place, f"vec_id {types['vec_id']}, label {types['label']}, node binary, vector binary, cells array<int>"),
        "placed-vectors")
    copies = placed.filter("node IS NOT NULL").groupBy(F.col("node").alias("of")).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = staged(
        placed.drop("vec_id").dropDuplicates(["node"]).join(copies, F.col("node") == F.col("of")).drop("of"), "vector-nodes")

    cell = ["label", "size", "cell"]
    spread = nodes.filter(F.col("node").isNotNull()).withColumns({
        "size": F.length("vector"), "cell": F.explode("cells")})
    blocks = spread.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    # A lone vector of a cell meets nobody there.
    crowded = blocks.filter("n > 1").drop("n")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = (
        spread.join(crowded, cell).withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    )
    found = staged(
        pairs.select(*cell, "lo", "hi", "block", "node", "vector", "cells", "copies")
        .groupBy(*cell, "lo", "hi").applyInArrow(_compare(least), "node binary, links long, mate binary"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("node != mate").select(F.col("node").alias("u"), F.col("mate").alias("v")))
    # Components are named by their least vec_id; each node knows the least of its copies.
    homes = staged(
        nodes.select("node", "copies", "least_id").join(roots, "node", "left").join(links, "node", "left")
        .select("node", "copies", "least_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")),
        "vector-homes")
    names = staged(homes.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component")), "vector-names")
    known = homes.join(names, F.col("root") == F.col("r")).select(
        F.col("node").alias("of"), (F.col("links") + F.col("copies") - 1).alias("links"), "component")
    linked = placed.select("vec_id", "node").join(staged(known, "vector-answers"), F.col("node") == F.col("of"), "left")
    out = linked.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    rest = rows.filter("NOT coalesce(label IS NOT NULL AND size(embedding) > 0, false)").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
