"""Connected components of a graph too large for one machine: distributed union-find.

Each round every node hooks onto its smallest neighbour, the resulting trees are
flattened by pointer doubling, and the graph is contracted to the trees' roots.
Rounds end when no edge is left, after a number of rounds logarithmic in the size
of the graph.  Every round's tables go to shared storage, so that a lost executor
costs one round at most.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.storage import drop_materialised, materialise

#: Doublings in a round: paths of up to 2**JUMPS hooks are flattened at once.
JUMPS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of an edge (``a``, ``b``).

    Loops and repeated edges are harmless; edges with a null end are ignored.  An
    empty table gives an empty result.  Nodes may be of any orderable type.
    """
    edges = materialise(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    nodes = materialise(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "nodes"
    )
    links = edges.where("a <> b")
    while not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hook = both.groupBy("a").agg(F.min("b").alias("up")).select("a", F.least("a", "up").alias("up"))
        hook = materialise(hook, "hooks")
        for _ in range(JUMPS):
            upper = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = materialise(hook.join(upper, "up", "left").select("a", F.coalesce("top", "up").alias("up")), "hooks")
            drop_materialised(hook)
            hook = jumped
        roots = hook.select(F.col("a").alias("component"), "up")
        moved = materialise(nodes.join(roots, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "nodes")
        left, right = hook.withColumnsRenamed({"up": "ua"}), hook.withColumnsRenamed({"a": "b", "up": "ub"})
        contracted = (
            links.join(left, "a").join(right, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        contracted = materialise(contracted, "edges")
        for old in (links, nodes, hook):
            drop_materialised(old)
        links, nodes = contracted, moved
    return nodes
