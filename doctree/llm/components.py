"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Tables


def components(links: DataFrame, tables: Tables, rows: int) -> DataFrame:
    """(node, root, ..) for every node of links (a, b): root is the smallest node that links lead to. rows: the number of links.

    Each round takes the smallest root among a node and its neighbours, then the root of that root; the number of
    rounds is about the logarithm of the longest shortest path. Rounds are written to the shared folder, the one
    before the last is deleted; the table that is returned belongs to tables.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    # The first round needs no join: the smallest neighbour.
    roots = tables.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), 2 * rows)
    while True:
        own = roots.select("node", "root")
        near = both.join(own, both["b"] == own["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = own.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        above = own.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = tables.cut(lower.join(above, "root").select("node", F.least("root", "top").alias("root"), "was"), 2 * rows)
        tables.drop(roots)
        roots = after
        if not after.filter("root <> was").limit(1).count():
            return roots
