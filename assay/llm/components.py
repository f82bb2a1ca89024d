"""Connected components of a graph given as links between long ids.

Labels are lowered to the smallest neighbour and links are rewired to the labels until every
link ends at the smallest id of its component. A round halves the distances at least about, so
their number grows with the logarithm of the longest chain. Links are stored between rounds in
the shared folder: lost executors only cost the tasks they ran. A node with very many links is
no group anywhere; its minimum is taken by partial aggregates, and the joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.sources.tables import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links(a, b)``; the component is its smallest id.

    Self links and repeated links are harmless, null ends are dropped. An empty table gives an
    empty table. Large and small star steps alternate; both keep the graph's components.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(links.where("a != b").select("a", "b").distinct(), "links")
    while True:
        # large star: neighbours above a node are linked to the smallest of its neighbourhood
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = (
            around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        ).where("a != b")
        large = stage(large.distinct(), "links")
        # small star: the same for the neighbours below it and the node itself
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
            .where("a != b")
        )
        small = stage(small.distinct(), "links")
        # done when no node has two links and no end of a link begins another
        tops = small.groupBy("a").agg(F.count("*").alias("n"))
        open_ends = small.join(tops.select(F.col("a").alias("b")), "b", "left_semi")
        again = tops.where("n > 1").limit(1).count() or open_ends.limit(1).count()
        edges = small
        if not again:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
