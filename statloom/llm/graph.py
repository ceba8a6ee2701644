"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, root for every node that is not the smallest of its component (the root); links has a, b.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their ends by
    doubling, and goes on with the links between different ends; the rounds needed grow with the logarithm of the
    longest path. Minima combine before the shuffle, and joins meet hot nodes as ordinary skewed joins of written tables.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()
    edges = cut_lineage(edges, "edges")
    labels = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).limit(0)
    while not edges.isEmpty():
        hooks = cut_lineage(edges.groupBy("hi").agg(F.min("lo").alias("up")), "hooks")
        while True:
            above = hooks.select(F.col("hi").alias("up"), F.col("up").alias("higher"))
            jumped = cut_lineage(hooks.join(above, "up", "left"), "jumps")
            if jumped.where("higher IS NOT NULL").isEmpty():
                break
            hooks = jumped.select("hi", F.coalesce("higher", "up").alias("up"))
        onward = hooks.select(F.col("hi").alias("root"), "up")
        labels = labels.join(onward, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = cut_lineage(labels.unionByName(hooks.select(F.col("hi").alias("node"), F.col("up").alias("root"))), "labels")
        of_hi, of_lo = hooks.withColumnRenamed("up", "hi_root"), hooks.select(F.col("hi").alias("lo"), F.col("up").alias("lo_root"))
        moved = edges.join(of_hi, "hi").join(of_lo, "lo", "left").select("hi_root", F.coalesce("lo_root", "lo").alias("lo_root"))
        moved = moved.select(F.greatest("hi_root", "lo_root").alias("hi"), F.least("hi_root", "lo_root").alias("lo"))
        edges = cut_lineage(moved.where("hi != lo").distinct(), "edges")
    return labels
