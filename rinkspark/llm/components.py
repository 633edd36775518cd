"""Connected components of a link table, by alternating large-star and
small-star steps (Kiveris et al., 2014) as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import staged


def _starred(arcs: DataFrame, keep_larger: bool) -> DataFrame:
    """Link every neighbour of a node to the least of its neighbourhood.

    ``arcs`` (u, v) holds what each node sees. The minimum per node is a
    partial aggregate; the join back is split by AQE where a node is hot.
    """
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = arcs.join(least, "u")
    if keep_larger:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node with a link; the component is its
    least node. Each round is written to the shared folder, so lineage stays
    short and lost executors repeat one round at most."""
    edges = staged(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _starred(both, True)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = staged(_starred(down, False), "edges")
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
