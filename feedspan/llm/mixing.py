"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedspan.llm.common import word_count
from feedspan.sources.storage import staged

LEVELS = ("domain", "lang", "source")
LEAF = [f"leaf_{x}" for x in LEVELS]
#: Parts of a leaf's seeded order; only the part that the budget cuts is sorted row by row.
PARTS = 4096
UNKNOWN = "unknown"


def source_domain() -> Column:
    """Stand-in for a domain column, which `documents` lacks: sources in four fixed families."""
    return F.when(F.col("source").isNull(), UNKNOWN).otherwise(
        F.concat(F.lit("domain"), F.crc32(F.col("source").cast("binary")) % 4)
    )


def weight_table(spark: SparkSession, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(level, name, weight) rows of a small mapping; what it doesn't name weighs 1."""
    rows = [(level, name, float(w)) for level, named in weights.items() for name, w in named.items()]
    return spark.createDataFrame(rows, "level string, name string, weight double")


def _leaves(docs: DataFrame, domain: Column) -> DataFrame:
    keys = (domain, F.col("lang"), F.col("source"))
    return docs.withColumns({
        leaf: F.coalesce(key.cast("string"), F.lit(UNKNOWN)) for leaf, key in zip(LEAF, keys, strict=True)
    })


def _share_out(nodes: DataFrame, parents: DataFrame | None, budget: Column, level: int) -> DataFrame:
    """Split each parent's budget among its children by weight, no child beyond its capacity.

    Water filling: children in ascending order of capacity per weight are full as long as that
    ratio is below the level the rest would reach without them. A child's capacity is that of
    its whole subtree, so a shortage below is made good among siblings first, and only what a
    full subtree can't take goes to the siblings of its ancestor.
    """
    up = LEAF[:level]
    if parents is not None:
        nodes = nodes.join(parents.select(*up, F.col("budget").alias("given")), up)
    else:
        nodes = nodes.withColumn("given", budget)
    parent = Window.partitionBy(*(up or [F.lit(1)]))
    order = parent.orderBy(F.col("capacity") / F.col("weight"), LEAF[level])
    before, onward = (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)
    filled = nodes.withColumns({
        "__ratio": F.col("capacity") / F.col("weight"),
        "__level": (F.col("given") - F.coalesce(F.sum("capacity").over(order.rowsBetween(*before)), F.lit(0.0)))
        / F.sum("weight").over(order.rowsBetween(*onward)),
    })
    # The first child that isn't full sets the water level of all after it.
    open_level = F.min_by(
        F.when(F.col("__ratio") > F.col("__level"), F.col("__level")),
        F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", LEAF[level])),
    ).over(parent)
    share = F.when(F.col("__ratio") <= F.col("__level"), F.col("capacity")).otherwise(
        F.least(F.col("capacity"), F.col("weight") * open_level))
    return filled.withColumn("budget", F.greatest(F.floor(share), F.lit(0)).cast("double")).drop(
        "given", "__ratio", "__level")


def leaf_budgets(
    leaves: DataFrame, weights: DataFrame | None, fraction: float, max_epochs: int
) -> DataFrame:
    """Token budget of each leaf. leaves: LEAF columns and `tokens`, one row per leaf.

    The whole budget is `fraction` of all tokens; a leaf can give `max_epochs` times its own.
    """
    sized = leaves
    for level, leaf in zip(LEVELS, LEAF, strict=True):
        if weights is None:
            sized = sized.withColumn(f"w_{leaf}", F.lit(1.0))
        else:
            named = weights.filter(F.col("level") == level).select(F.col("name").alias(leaf), F.col("weight").alias(f"w_{leaf}"))
            sized = sized.join(named, leaf, "left").fillna({f"w_{leaf}": 1.0})
    # A weight of nothing anywhere above a leaf is a capacity of nothing, for its ancestors too.
    wanted = F.least(*(F.col(f"w_{leaf}") for leaf in LEAF)) > 0
    sized = sized.withColumn("capacity", F.when(wanted, (F.col("tokens") * max_epochs).cast("double")).otherwise(0.0))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    parents = None
    for level, leaf in enumerate(LEAF):
        # The division needs some weight.
        nodes = sized.groupBy(*LEAF[: level + 1]).agg(
            F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"),
            F.greatest(F.max(f"w_{leaf}"), F.lit(1e-12)).alias("weight"))
        parents = _share_out(nodes, parents, F.lit(total * fraction), level)
    return parents


def _order(seed: int) -> Column:
    """Place of a row in the seeded order of its leaf's last epoch: uniform over 2^52."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id")), 12)


def _plan(rows: DataFrame, weights: DataFrame | None, fraction: float, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: whole epochs, tokens of the last epoch, and where the budget cuts its order."""
    totals = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    budgets = staged(leaf_budgets(totals, weights, fraction, max_epochs), "leaf-budgets").withColumns({
        "epochs": F.floor(F.col("budget") / F.col("tokens")).cast("long"),
        "rest": (F.col("budget") % F.col("tokens")).cast("long"),
    })
    part = F.shiftright(_order(seed), 40)
    parts = (
        rows.join(budgets.select(*LEAF, "epochs", "rest"), LEAF)
        .groupBy(*LEAF, "epochs", "rest", part.alias("part")).agg(F.sum("n_tokens").alias("tokens"))
    )
    before = Window.partitionBy(*LEAF).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        parts.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .filter("start <= rest AND start + tokens > rest")
        .select(*LEAF, F.col("part").alias("cut_part"), F.col("start").alias("cut_start"))
    )
    return budgets.select(*LEAF, "weight", "tokens", "budget", "epochs", "rest").join(cut, LEAF, "left")


def take_counts(
    docs: DataFrame,
    weights: DataFrame | None = None,
    fraction: float = 0.6,
    max_epochs: int = 2,
    seed: int = 17,
    domain: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """All columns of `docs`, with its leaf, `n_tokens` and `taken`: how often the mix holds the row.

    Each leaf gives whole epochs, then the token prefix of one more epoch in seeded order: rows
    as long as their running total stays within the budget. Rows without tokens are never taken.
    Null languages, sources and domains belong to the leaf `unknown`. Equal rows of a leaf share
    a place in the order and are taken one by one. Empty input: no rows. The names that begin
    with leaf_, n_tokens and taken are the operator's: such columns of `docs` are replaced.
    """
    domain = source_domain() if domain is None else domain
    tokens = word_count(F.col("text")) if tokens is None else tokens
    leafed = _leaves(docs, domain).withColumn("n_tokens", F.coalesce(tokens.cast("long"), F.lit(0)))
    rows = staged(leafed.select("doc_id", *LEAF, "n_tokens").filter("n_tokens > 0"), "mix-rows")
    plan = staged(_plan(rows, weights, fraction, max_epochs, seed), "mix-plan").select(
        *LEAF, "epochs", "rest", "cut_part", "cut_start")

    placed = (
        leafed.drop("epochs", "rest", "cut_part", "cut_start", "__order", "__part", "taken").join(plan, LEAF, "left")
        .withColumn("__order", _order(seed)).withColumn("__part", F.shiftright("__order", 40))
    )
    held = (F.col("n_tokens") > 0) & F.col("epochs").isNotNull()
    cut = held & (F.col("__part") == F.col("cut_part"))
    whole = placed.filter(~F.coalesce(cut, F.lit(False))).withColumn(
        "taken",
        F.when(held, F.col("epochs") + (F.col("__part") < F.col("cut_part")).cast("long"))
        .otherwise(F.lit(0)))
    # One part in 4,096 of a leaf's order: the only rows that are sorted.
    upto = Window.partitionBy(*LEAF).orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = placed.filter(cut).withColumn("__upto", F.col("cut_start") + F.sum("n_tokens").over(upto)).withColumn(
        "taken", F.col("epochs") + (F.col("__upto") <= F.col("rest")).cast("long")).drop("__upto")
    out = whole.unionByName(sorted_)
    return out.withColumn("taken", F.col("taken").cast("long")).drop(
        "epochs", "rest", "cut_part", "cut_start", "__order", "__part")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of `docs` with all their columns, each as often as it is taken."""
    rows = docs.select("doc_id", "lang", "source", "text", F.struct("*").alias("__row"))
    taken = take_counts(rows, **options).filter("taken > 0").select("__row", "taken")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken")))).select("__row.*")
