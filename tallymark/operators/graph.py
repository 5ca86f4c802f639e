"""Connected components of an undirected graph, by contraction to minima.

Every round maps each node to the least node in its neighbourhood, once more through that node's own map, and rewrites the edges
between the images; an edge inside one image goes. Minima never move, so the node that is left of a component
is its smallest. Each round is written to the shared folder, so lineage stays short and a lost executor costs no rerun of earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (smallest node) of every node that has an edge; isolated nodes do not appear.

    Null ends and self-loops are dropped. Works for any orderable type.
    """
    left = staged(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") < F.col("b"))).distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select(F.col("b"), F.col("a")))
        step = both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to"))
        step = staged(step, "step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = staged(step.join(jump, "to").select("node", F.col("far").alias("to")), "jump")
        if found is None:
            found = step.select("node", F.col("to").alias("component"))
        else:
            found = found.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = staged(found, "components")
        image_a, image_b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = left.join(image_a, "a").join(image_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        left = staged(left, "edges")
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
