"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.storage import shared_folder


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, component): the least node reachable from each node that has a link.

    Each round is two aggregations with map-side combining and two equi-joins; the star around a hot
    node is split by adaptive skew joins, as no round gathers a node's links in one row.  Rounds
    are cut with ``checkpoint()``.  Links with a null end and loops are ignored; an empty table
    gives an empty table.
    """
    shared_folder(edges.sparkSession)
    e = (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u != v")
        .distinct()
        .checkpoint()
    )
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct().checkpoint()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(down.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
        # a forest of stars: every node has one link at most, and no centre is a leaf
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e"))
        if ends.groupBy("e.node").agg(F.sum("e.leaf").alias("leaf"), F.min("e.leaf").alias("least")).where("leaf > 1 or leaf = 1 and least = 0").isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(centres)
