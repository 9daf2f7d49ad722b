"""Connected components of a link table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and
    beyond", 2014) until nothing changes: every node's neighbours are tied to the smallest of them. The
    number of rounds grows with the logarithm of the longest chain. Edges never outnumber the
    links, and the smallest neighbour is aggregated before edges move. An empty table gives none.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        edges = cut(small.select("a", F.col("m").alias("b")).unionByName(tied).distinct())
        # edges are always (node, smaller node); when every node has one edge to a root, counts and sums stand still
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
