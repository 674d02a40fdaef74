"""Smallest label reachable over links, for graphs whose nodes have few links each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.session import cut


def smallest_reachable(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, label): per node the smallest label of all nodes it can reach, its own included.

    ``nodes`` has node and label, and labels may repeat; ``links`` has a and b, either
    direction. Each round a node takes the smallest label of its neighbours, then the label which
    the owner of that label holds by now, so chains shrink by more than half a round. Every round is
    written to the shared folder: lineage stays short and a lost executor costs one round at most.
    Nodes without links keep their own label. No step gathers a component in one task.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    linked = both.select(F.col("a").alias("node")).distinct()
    state = cut(nodes.join(linked, "node").select("node", F.col("label").alias("own"), "label"), "labels")
    while True:
        near = (
            both.join(state.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lowered = cut(
            state.join(near, "node", "left").select("node", "own", F.col("label").alias("before"), F.least("label", "near").alias("label")),
            "labels",
        )
        owners = lowered.groupBy(F.col("own").alias("label")).agg(F.min("label").alias("owner_label"))
        jumped = lowered.join(owners, "label", "left").select(
            "node", "own", "before", F.least("label", "owner_label").alias("label")
        )
        state = cut(jumped, "labels")
        if state.filter(F.col("label") != F.col("before")).limit(1).count() == 0:
            break
    found = state.select("node", F.col("label").alias("found"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("found", "label").alias("label"))
