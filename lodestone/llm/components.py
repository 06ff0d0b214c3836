"""Connected components of a graph given as a table of links, by contraction.

In each round every node that has a smaller neighbour takes the smallest as its parent, chains of parents are
followed to their roots, and links are drawn anew between roots; links within a root vanish. Only links and parents
travel, aggregated before they are shuffled, and each round's tables are written, so no round depends on what an
executor held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def _smaller(links: DataFrame) -> DataFrame:
    """low < high, each link once."""
    return links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """node, parent with every parent a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = written(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a and b (long). One row for each node with a link to another: node, component (its smallest node)."""
    edges = written(_smaller(links), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        parents = _roots(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent")))
        rounds.append(parents)
        low = parents.select(F.col("node").alias("low"), F.col("parent").alias("low_root"))
        high = parents.select(F.col("node").alias("high"), F.col("parent").alias("high_root"))
        drawn = edges.join(low, "low", "left").join(high, "high").select(F.coalesce("low_root", "low").alias("a"), F.col("high_root").alias("b"))
        edges = written(_smaller(drawn), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    # Every node but the smallest of its component is a child in exactly one round.
    known = rounds[-1].select("node", F.col("parent").alias("component"))
    for parents in reversed(rounds[:-1]):
        above = known.select(F.col("node").alias("parent"), "component")
        known = known.unionByName(parents.join(above, "parent", "left").select("node", F.coalesce("component", "parent").alias("component")))
        known = written(known, "components")
    return known.unionByName(known.select(F.col("component").alias("node"), "component").distinct())
