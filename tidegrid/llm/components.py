"""Connected components by alternating stars (Kiveris and others, 2014); every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """Root of every node that has an edge: columns node, root, root being the smallest node reachable.

    edges: columns a, b of one orderable type. Loops, repeats and either direction are fine; a row with a null is no edge.
    Each round re-hangs neighbours under the smallest one known and halves long chains, so rounds grow with the
    logarithm of the longest chain. The minimum is taken before rows meet, so a node that many others touch is no hot task.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct()
        old, now = now, written(small, "links")
        dropped(old)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    roots = now.groupBy("src").agg(F.min("dst").alias("root")).withColumnRenamed("src", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
