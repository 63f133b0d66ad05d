"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspan.sources.storage import staged


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _stars(pairs: DataFrame) -> bool:
    """Whether every u has one v and no v is a u, so nothing can change any more; one grouping."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))).alias("e")).select("e.*")
    places = ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return places.filter((F.col("as_u") > 1) | ((F.col("as_u") > 0) & (F.col("as_v") > 0))).count() == 0


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the least node of its component.

    Alternating star contraction: large stars hang all greater neighbours of a node on its least
    neighbour, small stars do so with the lesser ones, until only stars are left. Only minima per node
    are aggregated, so a node of many neighbours is no group in one task. Every round is written
    to the shared folder. Loops (u = v) give single nodes; no edges give no rows.
    """
    def canonical(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()

    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    pairs = staged(canonical(edges), purpose)
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(_least(both), purpose)
        large = staged(canonical(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))), purpose)
        least = staged(_least(large), purpose)
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.*")
        pairs = staged(canonical(small), purpose)
    # Stars now: each node but the roots has one edge, to its root.
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
