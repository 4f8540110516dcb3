"""Connected components of a table of links, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Label every node that has a link with the least node it reaches: node, label. links: a, b (long).

    Each round gives every node the least label among its own, its neighbours' and its label's own label, and replaces
    links by links between labels; rounds grow with the logarithm of a component's diameter on usual graphs. Every
    round is written to the shared folder, so nothing is kept on one machine; a round's tables go when the next stand.
    """
    scratch = Scratch(links.sparkSession, name)
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, labels, step = scratch.write(edges, "links"), None, 0
    while not edges.isEmpty():
        # the least neighbour of every node of the contracted graph
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
        hop = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        least = scratch.write(least.join(hop, "label").select("node", F.col("next").alias("label")), f"least-{step}")
        if labels is None:
            labels = least
        else:
            new = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(new, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            labels = scratch.write(labels, f"labels-{step}")
        a, b = (least.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b").distinct()
        edges = scratch.write(edges, f"links-{step}")
        scratch.drop("links" if step == 0 else f"links-{step - 1}")
        if step:
            scratch.drop(f"least-{step}", "least-0" if step == 1 else f"labels-{step - 1}")
        step += 1
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, label long")
    return labels
