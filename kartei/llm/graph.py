"""Connected components of a link table by star contraction, each round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.plans.storage import written


def _smallest(edges: DataFrame) -> DataFrame:
    """Adds low, the smallest neighbour of a (or a itself)."""
    least = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("_a"), F.least("a", "low").alias("low"))
    return edges.join(least, F.col("a") == F.col("_a")).drop("_a")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node that is reachable) for each node in links (a, b).

    Large-star and small-star alternate: each points nodes at the smallest
    neighbour seen, so the number of rounds follows the logarithm of a component's
    size and a node of very many links costs no more than its links. Groups are
    never collected, only their minimum is taken. Links of a node with itself are ignored.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        large = _smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = _smallest(large)
        small = low.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = written(small.filter("a <> b").distinct(), "links")
        # equal sums of hashes: no link changed
        now = edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
