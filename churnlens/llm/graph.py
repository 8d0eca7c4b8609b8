"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import drop_stored, stored


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(src long, dst long) -> (node, root): root is the smallest node id of the component.

    Each round every node takes the smallest label among its own and its neighbours' labels, and then
    the label of that label (pointer jumping), until no label changes.  Neighbour minima are combined
    before the shuffle, so a hub of any degree is no hot task; the label look-ups are shuffled joins that
    adaptive execution can split.  Each round is a written table (no lineage growth).  Nodes without an
    edge do not appear; null ends and self loops are ignored; an empty list gives an empty table.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    e = stored(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = stored(e.groupBy(F.col("src").alias("node"))
                    .agg(F.least(F.min("dst"), F.col("node")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = (e.join(labels.withColumnRenamed("node", "dst"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near")))
        step = (labels.join(near, "node")
                .select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = (step.join(up, "root", "left")
                .select("node", "old", F.least("root", "above").alias("root")))
        step = stored(step, "labels")
        changed = step.where("root <> old").limit(1).count()
        drop_stored(labels)
        labels = step.select("node", "root")
        if not changed:
            drop_stored(e)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
