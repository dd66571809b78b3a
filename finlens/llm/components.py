"""Connected components of a link table, and the roots of a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import save


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every node that
    has a link in ``links`` (a, b).

    Each round takes the smallest label among neighbours, then the label of
    that label, so stars settle in two rounds and chains in about the
    logarithm of their length.  Rounds are written to the shared folder; only
    a count reaches the driver.  Minima are partially aggregated, so a node
    with very many links sends few rows per task.
    """
    both = save(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct(), "links", narrow=True)
    if both.isEmpty():
        return both.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    labels = save(both.groupBy(F.col("src").alias("node")).agg(
        F.least(F.col("node"), F.min("dst")).alias("label")), "labels", narrow=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst")
        near = near.groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                F.least("label", "near").alias("label"))
        top = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = step.join(top, "label").select("node", "old", F.least("label", "top").alias("label"))
        step = save(step, "labels", narrow=True)
        labels = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return labels


def roots(parents: DataFrame) -> DataFrame:
    """(node, label): the root above each node of a forest, for every node of
    ``parents`` (node, up), at most one row per node and no cycles.

    Each round replaces the node above by the one above that: a join of two
    narrow tables, and as many rounds as the logarithm of the depth.
    """
    steps = save(parents.select("node", "up", F.lit(True).alias("moved")), "roots", narrow=True)
    while not steps.where("moved").isEmpty():
        top = steps.select(F.col("node").alias("up"), F.col("up").alias("top"))
        steps = save(steps.drop("moved").join(top, "up", "left").select(
            "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "roots", narrow=True)
    labels = steps.select("node", F.col("up").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
