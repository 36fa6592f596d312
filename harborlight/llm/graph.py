"""Connected components of a table of links, by alternating large and small stars; nothing of it goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, component) of every node of links(a, b); component is the smallest node that can be reached.

    Each round joins every node's larger neighbours, then its smaller ones, to the smallest it knows; rounds end when no edge
    leads on, after about the logarithm of the longest path. Each round's edges are a table in the shared folder. The edges of a hub,
    16 bytes each, are split by AQE's skew join once they are over its threshold, as each join has one row a node on its right.
    """
    edges = tables.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    k = 0
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        k += 1
        edges = tables.write(small, f"{name}-{k}")
        tables.drop(f"{name}-{k - 1}")
        if not edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)).distinct()).groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up + down > 1").limit(1).count():
            break  # stars: each node below has one edge, and no centre has one
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
