"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(a, b) -> (node, root): root is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then jumps to that label's own label,
    so the rounds grow with the logarithm of a component's diameter. Labels are written to the shared folder
    every round and never gathered on the driver; only the count of changes is. Loops, repeated edges and edges
    with a null end are allowed (the last are ignored); an empty graph gives no rows. Raises if not converged."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).filter("node IS NOT NULL AND to IS NOT NULL")
    both = cut(both.unionByName(both.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct())
    label = cut(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("to"), "root"), "to").groupBy("node").agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = cut(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        changed = new.filter("root <> old").limit(1).count()
        label = new.select("node", "root")
        if not changed:
            return label
    raise RuntimeError(f"components: not converged after {max_rounds} rounds")
