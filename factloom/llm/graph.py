"""Connected components of an edge list, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge; root is the smallest node reachable. edges: a, b bigint.

    Each round hooks every node to its smallest neighbour, shortens the chains by three jumps and
    contracts the edges; the number of nodes left falls at least by half for chains up to eight long,
    so rounds grow with the logarithm of the longest path. Null ends and loops are ignored.
    """
    e = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")))
        up = p.select(F.col("node").alias("up"), F.col("parent").alias("next"))
        jumped = p
        for _ in range(3):
            jumped = jumped.join(up, F.col("parent") == F.col("up"), "left").select("node", F.coalesce("next", "parent").alias("parent"))
        jumped = staged(jumped)
        to = lambda side: jumped.select(F.col("node").alias(side), F.col("parent").alias(f"p{side}"))
        e = staged(
            e.join(to("a"), "a").join(to("b"), "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        if labels is None:
            labels = jumped
        else:
            step = jumped.select(F.col("node").alias("at"), F.col("parent").alias("to"))
            labels = staged(labels.join(step, F.col("parent") == F.col("at"), "left").select("node", F.coalesce("to", "parent").alias("parent")))
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.select("node", F.col("parent").alias("root"))
