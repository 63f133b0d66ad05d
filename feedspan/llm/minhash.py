"""Near-duplicate texts by BagMinHash over multisets of five-word shingles.

A shingle that occurs c times covers the weights (0, c]. The weights are cut into dyadic blocks
(0, 1], (1, 2], (2, 4], (4, 8] ..., each with a Poisson process of its own seed and of its length
as rate; a point counts for a text if its position in the block is covered. Points fall on
random components of the signature and the earliest point of each component stays. Two texts
share a component's point with the probability of their weighted Jaccard similarity. Only points
before a horizon that fills every component are made.

Texts that agree in a band of components are candidates; the multisets themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspan.llm.components import components
from feedspan.sources.storage import staged

SHINGLE = 5
BANDS, ROWS = 32, 6  # a pair of similarity 0.8 shares no band once in 17,000 times
SIZE = BANDS * ROWS
CHUNK = 200_000  # shingles signed at once
FEW, BLOCK = 32, 256  # texts of a bucket whose pairs are joined; texts of a larger one on one side of a comparison
#: Three and a half standard deviations of the estimate below 0.8: a pair at 0.8 is less likely once in 4,300
#: times, more similar ones far more rarely, and a text has other pairs to be joined by.
SURELY_LESS = 0.7


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_words() -> Column:
    """Words of `text`: runs of letters, digits and _ in lower case, with single spaces between."""
    return F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}_]+", " "))


def word_node(words: Column) -> Column:
    """128 bits for a word sequence; null without words."""
    return F.when(words != "", F.unhex(F.md5(words)))


def shingles(words: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; fewer than five words are one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # The pattern leaves no other white space, and surrogates can't come from Spark's UTF-8.
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words.encode().split(b" ")], dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = mix(out ^ h[k : k + n])
    return np.unique(out, return_counts=True)


def copies(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorted ids of (shingle, 1) ... (shingle, count): the multiset as a set."""
    if count.max(initial=0) <= 1:
        return shingle
    again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(np.where(again == 0, np.repeat(shingle, count), mix(np.repeat(shingle, count) ^ mix(again.astype(np.uint64)))))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given by `copies`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def sign(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """Signatures (n_docs x SIZE) of the multisets whose rows are (doc, shingle, count)."""
    # Blocks of every row: 0 is (0, 1], k is (2^(k-1), 2^k].
    blocks = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), blocks)
    k = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    rate = np.where(k == 0, 1.0, 2.0 ** (k - 1))
    covered = count[row] - np.where(k == 0, 0, 2 ** np.maximum(k - 1, 0))
    seed, owner = mix(shingle[row] ^ mix(k.astype(np.uint64))), doc[row]
    weight = np.bincount(doc, count, n_docs)
    horizon = SIZE * (np.log(SIZE) + 3) / np.maximum(weight, 1)
    out = np.zeros((n_docs, SIZE), dtype=np.uint64)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n_docs else np.ones(len(owner), dtype=bool)
        s, r, c, o = seed[mine], rate[mine], covered[mine], owner[mine]
        x, step = np.zeros(len(s)), 0
        first, who = np.full(n_docs * SIZE, np.inf), np.zeros(n_docs * SIZE, dtype=np.uint64)
        while len(s):
            step += 1
            point = mix(s + np.uint64(step))
            x = x - np.log1p(-(point >> np.uint64(11)).astype(np.float64) * 2.0**-53) / r
            keep = x <= horizon[o]
            s, r, c, o, x, point = s[keep], r[keep], c[keep], o[keep], x[keep], point[keep]
            place = mix(point)
            level = ((place >> np.uint64(40)).astype(np.float64) * 2.0**-24 * r).astype(np.int64)  # units below the point
            inside = level < c
            at = o[inside] * SIZE + (place[inside] % np.uint64(SIZE)).astype(np.int64)
            now = x[inside]
            np.minimum.at(first, at, now)
            won = first[at] == now
            who[at[won]] = point[inside][won]
        full = np.isfinite(first.reshape(n_docs, SIZE)).all(1)[todo]
        out[todo[full]] = who.reshape(n_docs, SIZE)[todo[full]]
        todo = todo[~full]
        horizon = horizon * 2
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        out = mix(out ^ parts[:, :, k])
    return out


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, start, parts, size = batch.select(["doc_id", "node"]), 0, [], 0
        for i, words in enumerate(batch.column("words").to_pylist()):
            parts.append(shingles(words))
            size += len(parts[-1][0])
            if size >= CHUNK or i + 1 == batch.num_rows:
                yield _signed(keys.slice(start, len(parts)), parts)
                start, parts, size = i + 1, [], 0


def _signed(keys: pa.RecordBatch, parts: list) -> pa.RecordBatch:
    doc = np.repeat(np.arange(len(parts)), [len(s) for s, _ in parts])
    signature = sign(doc, np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts]), len(parts))
    bands = pa.ListArray.from_arrays(
        pa.array(np.arange(len(parts) + 1, dtype=np.int32) * BANDS), pa.array(band_hashes(signature).astype(np.int64).ravel()))
    short = [row.tobytes() for row in signature.astype(np.uint16)]  # of texts without words: never read
    return pa.RecordBatch.from_arrays(
        [*keys.columns, bands, pa.array(short, pa.binary())], names=["doc_id", "node", "bands", "signature"])


def _itemise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [copies(*shingles(t)).tobytes() for t in batch.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "items"])


def _overlapping(least: float) -> Callable:
    """Pairs (u, v) of rows (u, v, x, y) whose multisets x and y overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in pairs]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of rows (u, v, x, y) whose signatures agree enough."""
    for batch in batches:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = [(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean() >= SURELY_LESS for x, y in pairs]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _with_sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs (u, v) with the values of both ends."""
    left = values.select(F.col("node").alias("u"), F.col(column).alias("x"))
    right = values.select(F.col("node").alias("v"), F.col(column).alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")


def _compare_block(least: float) -> Callable:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """Links that join components, of one block of a bucket or between two of its blocks.

        A pair is verified in the first bucket that its texts share, likeliest pairs of a text first,
        unless its components are joined here already.
        """
        bucket, lo, hi = (k.as_py() for k in key)
        signature = np.stack([np.frombuffer(x, dtype=np.uint16) for x in group.column("signature").to_pylist()])
        bands = np.array(group.column("bands").to_pylist(), dtype=np.int64)
        items = [np.frombuffer(x, dtype=np.uint64) for x in group.column("items").to_pylist()]
        home = np.unique(np.array(group.column("home").to_pylist(), dtype=object), return_inverse=True)[1]
        left_over = group.column("left_over").to_numpy(zero_copy_only=False)
        block = group.column("block").to_numpy()
        nodes = group.column("node").to_pylist()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        parent = list(range(int(home.max()) + 1))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        us, vs = [], []
        for i in left.tolist():
            others = right if left_over[i] else right[left_over[right]]
            others = others[(home[others] != home[i]) & ((others > i) | (lo != hi))]
            equal = (signature[others] == signature[i]).sum(1)
            likely = np.flatnonzero(equal >= SURELY_LESS * SIZE)
            for j in others[likely[np.argsort(-equal[likely], kind="stable")]].tolist():
                x, y = find(int(home[i])), find(int(home[j]))
                if x != y and bands[i][np.argmax(bands[i] == bands[j])] == bucket and overlap(items[i], items[j]) >= least:
                    parent[max(x, y)] = min(x, y)
                    us.append(nodes[i])
                    vs.append(nodes[j])
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    left = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
    right = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    joined = pairs.join(left, "u", "left").join(right, "v", "left")
    return joined.filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).drop("ru", "rv")


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, node (the word sequence; null without words) and root (the class) of every row.

    docs: doc_id, text; other columns are ignored. Equal word sequences are one node, so repeated
    rows and copies make no pairs. Rows without words (null, empty, signs only) have no root: each
    is alone. Null ids take part like others. Empty input: no rows.

    Candidates are linear in the rows: in each bucket every text is compared with the bucket's
    first. Texts that join the first one's component are done with; each other one is compared with
    the whole bucket, in blocks, by signatures and then by multisets, so no pair that shares a band is lost and
    only links come out. The best candidate of each text is
    verified first, and candidates that meanwhile are in one component aren't verified at all.
    """
    words = plain_words()
    worded = docs.select("doc_id", word_node(words).alias("node"), words.alias("words"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = staged(worded.mapInArrow(
        _sign_batches, f"doc_id {id_type}, node binary, bands array<long>, signature binary"), "signatures")
    known = signed.filter("node IS NOT NULL")
    rows = known.select("node", F.explode("bands").alias("bucket")).distinct()
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1")
    members = staged(rows.join(buckets, "bucket").select("bucket", "node", "n", "first"), "members")
    stars = staged(
        members.filter("node != first").groupBy(F.col("node").alias("u"), F.col("first").alias("v"))
        .agg(F.count("*").alias("bands")), "stars")
    best = stars.groupBy("u").agg(F.max_by("v", F.struct("bands", "v")).alias("v"))

    # Multisets of the texts that have a candidate, each made once, whatever the number of its copies.
    wanted = members.select("node").distinct()
    one_each = (
        known.select("doc_id", "node").join(wanted, "node", "left_semi").groupBy("node")
        .agg(F.min("doc_id").alias("one")).withColumnRenamed("node", "of"))
    items = staged(
        worded.join(one_each, F.col("doc_id").eqNullSafe(F.col("one")) & (F.col("node") == F.col("of")), "left_semi")
        .select("node", "words").mapInArrow(_itemise, "node binary, items binary").dropDuplicates(["node"]), "items")

    def links(pairs: DataFrame) -> DataFrame:
        sides = _with_sides(pairs, items, "items")
        return staged(sides.mapInArrow(_overlapping(similarity), "u binary, v binary"), "links")

    def joined(roots: DataFrame, *found: DataFrame) -> DataFrame:
        if all(pairs.isEmpty() for pairs in found):
            return roots
        more = reduce(DataFrame.unionByName, found)
        known = roots.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        return staged(components(known.unionByName(more)), "roots")

    roots = staged(components(links(best)), "roots")
    others = stars.select("u", "v").join(best, ["u", "v"], "left_anti")
    roots = joined(roots, links(_apart(others, roots)))

    # What isn't joined to its bucket's first text meets the whole bucket.
    home = F.coalesce("root", "node").alias("home")
    named = roots.select(F.col("node").alias("first"), F.col("root").alias("first_root"))
    placed = (
        members.filter("n > 2").join(roots, "node", "left").select("bucket", "node", "first", home)
        .join(named, "first", "left").select("bucket", "node", "first", "home", F.coalesce("first_root", "first").alias("first_home"))
    )
    placed = placed.withColumn("left_over", F.col("home") != F.col("first_home"))
    over = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("left_over").alias("left"))
    placed = staged(
        placed.join(over.filter("left > 0"), "bucket").select("bucket", "node", "home", "left_over", "n"), "placed")
    signatures = staged(
        known.join(placed.select("node").distinct(), "node", "left_semi").select("node", "signature", "bands")
        .dropDuplicates(["node"]), "left-signatures")
    # In small buckets the pairs are few; large ones are compared and verified in blocks.
    few, many = placed.filter(F.col("n") <= FEW), placed.filter(F.col("n") > FEW)
    pairs = (
        few.filter("left_over").select("bucket", F.col("node").alias("a"), F.col("home").alias("a_home"))
        .join(few, "bucket").filter("a_home != home")
        .select(F.greatest("a", "node").alias("u"), F.least("a", "node").alias("v")).distinct()
    )
    likely = _with_sides(pairs, signatures, "signature").mapInArrow(_agreeing, "u binary, v binary")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = (
        many.join(signatures, "node").join(items, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .select("bucket", "lo", "hi", "block", "node", "home", "left_over", "signature", "bands", "items")
        .groupBy("bucket", "lo", "hi").applyInArrow(_compare_block(similarity), "u binary, v binary")
    )
    roots = joined(roots, links(likely), staged(met, "block-links"))

    found = signed.select("doc_id", "node").join(roots, "node", "left")
    return found.select("doc_id", "node", F.when(F.col("node").isNotNull(), F.coalesce("root", "node")).alias("root"))


def duplicate_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (least doc_id of the class) and kept (doc_id = component_id) of every row."""
    rows = staged(near_duplicates(docs, similarity), "near-duplicates")
    least = staged(
        rows.filter("root IS NOT NULL").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least")), "least")
    joined = rows.join(least, F.col("root") == F.col("of"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select(
        "doc_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of `docs` of each class, with all its columns: one with the least doc_id.

    Rows without words all stay. Of rows that repeat both id and words one stays.
    """
    rows = staged(near_duplicates(docs, similarity).filter("root IS NOT NULL"), "near-duplicates")
    # The least (id, words) of a class; a null id comes after all others.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    chosen = rows.groupBy("root").agg(F.min(order).alias("c")).select("c.doc_id", "c.node")
    repeated = rows.groupBy("doc_id", "node").count().filter("count > 1").select(
        F.col("doc_id").alias("r_id"), F.col("node").alias("r_node"), F.lit(True).alias("__repeated"))
    keep = staged(
        chosen.join(repeated, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("node") == F.col("r_node")), "left")
        .select(F.col("doc_id").alias("__id"), F.col("node").alias("__of"), "__repeated"), "kept-documents")
    noded = docs.withColumn("__node", word_node(plain_words()))
    found = noded.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__of")), "inner")
    once = found.filter("__repeated IS NULL")
    number = F.row_number().over(Window.partitionBy("__id", "__of").orderBy("__of"))
    several = found.filter("__repeated").withColumn("__n", number).filter("__n = 1")
    parts = (once, several, noded.filter("__node IS NULL"))
    kept = [p.select(*docs.columns) for p in parts]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])
