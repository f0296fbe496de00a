"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, scratch: Scratch | None = None, name: str = "edges") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    Each round hooks every node's neighbours onto its smallest neighbour with grouped minima and equi-joins, so no
    neighbour list is ever gathered and a node with very many edges is only a skewed join key, which adaptive
    execution splits. Rounds needed grow with the logarithm of the longest path; each replaces the table `name` of the
    one before. Self-loops and edges with a null end add nothing; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e, seen = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), None
    e = scratch.keep(name, e)
    for _ in range(most_rounds):
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            break
        seen = sign
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.keep(name, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
