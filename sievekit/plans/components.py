"""Connected components of an undirected edge list (min-label propagation).

GraphFrames is not available; the algorithm is plain DataFrame joins and
aggregations. Each round every node takes the least label among itself and
its neighbours, then jumps to its label's label (pointer jumping, so chains
shrink geometrically). Rounds stop when no label changes. Labels are
checkpointed to the shared checkpoint folder every round: lineage stays
short and a lost executor re-reads the last round instead of all of them.
A hub node (one id linked to a third of all rows) is a skewed join key; its
edges are reduced by partial aggregation and AQE's skew-join split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.session import checkpoint_root


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """Return ``node, component`` (component = least node id) for every node in ``edges``."""
    checkpoint_root(edges.sparkSession)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a") != F.col("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.checkpoint(eager=True)
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = labels.checkpoint(eager=True)
    for _ in range(max_rounds):
        # least label among neighbours
        nb = both.join(labels.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a")
        prop = nb.groupBy("b").agg(F.min("la").alias("cand")).withColumnRenamed("b", "node")
        step = labels.join(prop, "node", "left").select(
            "node", F.least(F.col("label"), F.coalesce(F.col("cand"), F.col("label"))).alias("label"))
        # pointer jumping: label := label(label)
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("l2")), "label", "left")
        new = jump.select("node", F.least(F.col("label"), F.coalesce(F.col("l2"), F.col("label"))).alias("label"))
        new = new.checkpoint(eager=True)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter(F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    else:
        raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
    return labels.withColumnRenamed("label", "component")
