"""Connected components by alternating large-star and small-star.

Neighbour lists are never gathered: each star is a minimum by aggregation and a join back, so a node with any number
of neighbours is pre-aggregated, and the join can split its rows. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyetos.llm.common import written


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (u, v): one row (u, v) for each node that isn't the smallest of its component, v being the smallest."""
    edges = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark["n"]:
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.c).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        center = root.select(F.col("u").alias("c"), "m")
        rest = large.join(center, large.u == center.c).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(rest.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(edges)
        if now == mark:
            return edges
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
