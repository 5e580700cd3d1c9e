"""Connected components of an edge table, for keys of any type that has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b); root: the least node that is linked with it, itself included.

    Every node points to a node that is not greater. A round hooks a node, and what it points to, to the least grandparent among
    the node's neighbours, and shortens its way to its own grandparent (Zhang, Azad and Hu, 2020), so rounds follow the logarithm of
    the longest chain. Each is a few joins and one pre-aggregated minimum, written before the next.
    """
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    parents = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("parent")), "parents")
    while True:
        grand = parents.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent").select("node", "parent", "grand")
        least = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("least"))
        hooked = grand.join(least.withColumnRenamed("a", "node"), "node", "left").select("node", "parent", F.least("grand", "least").alias("to"))
        moves = hooked.select(F.explode(F.array(F.struct("node", "to"), F.struct(F.col("parent").alias("node"), "to"))).alias("m")).groupBy("m.node").agg(F.min("m.to").alias("parent"))
        new = stored(moves, "parents")
        changed = new.join(parents.withColumnRenamed("parent", "old"), "node").filter("parent <> old").limit(1)
        if changed.isEmpty():
            return new.select("node", F.col("parent").alias("root"))
        parents = new
