"""Connected components of a graph that is held as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.shared import drop, stage

#: Edges for a task, at least.
EDGES = 1 << 15


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: nodes' labels lowered to the least label of the nodes they reach over edges (u, v).

    nodes: node, label, where a label is itself a node with that label or a lower one. Each round takes the least label
    of the neighbours and then the label of that label, so the rounds grow with the logarithm of a path. A node with
    very many edges costs no more than its edges: the least label is combined before the shuffle.
    """
    edges = stage(edges.select("u", "v"), "given-edges")
    # A round over few edges is not worth a task for each shuffle partition.
    parts = -(-edges.count() // EDGES) or 1
    both = stage(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().coalesce(parts), "edges")
    lab = nodes
    touched = both.select(F.col("u").alias("node")).distinct()
    some, rest = lab.join(touched, "node", "left_semi"), lab.join(touched, "node", "left_anti")
    # Labels that stand for whole groups take part through the edge from each node to its label.
    links = both.select("u", "v").union(some.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))).union(some.where("node <> label").select(F.col("label").alias("u"), F.col("node").alias("v")))
    links = stage(links.distinct().coalesce(parts), "links")
    now = stage(links.select(F.col("u").alias("node")).distinct().join(lab, "node").coalesce(parts), "labels")
    while True:
        near = links.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("_least"))
        low = now.join(near, "node").select("node", F.least("label", "_least").alias("_low"), "label")
        jump = now.select(F.col("node").alias("_low"), F.col("label").alias("_next"))
        new = stage(low.join(jump, "_low", "left").select("node", F.least("_low", F.coalesce("_next", "_low")).alias("label"), (F.least("_low", F.coalesce("_next", "_low")) != F.col("label")).alias("_moved")).coalesce(parts), "labels")
        drop(now)
        now = new
        if new.where("_moved").isEmpty():
            break
    # A group whose label fell takes all its nodes along, those without an edge too.
    fell = now.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    out = lab.join(now.select("node", F.col("label").alias("_own")), "node", "left").join(fell, "label", "left")
    out = stage(out.select("node", F.least(F.coalesce("_own", "label"), F.coalesce("_to", "label")).alias("label")), "components")
    drop(edges, both, links, now)
    return out
