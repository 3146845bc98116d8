"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected ``edges`` (src, dst); component is the least node of it.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which
    shrink any graph to stars in about log² of its size. Each step is one
    aggregation and one join on the edge table; its result is checkpointed. Self
    loops and repeated edges are allowed; null ends are dropped; an empty table
    gives an empty table.
    """
    now = edges.select(F.col("src"), F.col("dst")).where("src is not null and dst is not null")
    nodes = now.select(F.col("src").alias("node")).union(now.select("dst")).distinct()
    now = cut(now.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        now = cut(small.where("u <> v").distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
