"""Connected components of a graph given as edges between integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, removed, scratch, written

#: So many minima at most are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 200_000


def connected_components(edges: DataFrame, *, most_rounds: int = 60, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(node, component) for each node of ``edges`` (src, dst: long), the component being its least node.

    Alternating star contraction: each round first hangs every larger neighbour of a node on the node's least
    neighbour, then every smaller neighbour.  Rounds grow with the logarithm of a component's size.  Nothing is
    gathered by node: minima are summed up before the shuffle and written, so that Spark can split the joins where a
    node has very many edges.  Each round's tables are written, so a lost executor costs one step at most, and
    deleted once the next round's are there.  Stars take one look.
    """
    spark = edges.sparkSession
    prepare(spark)
    folder, before = scratch(spark, "components"), None
    apart = edges.where("src <> dst and src is not null and dst is not null")
    now = written(apart.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), f"{folder}/0")
    for k in range(most_rounds + 1):
        # the least neighbour of each node, or itself; settled are nodes that hang on one node alone, or on none
        ends = now.select(F.explode(F.array(F.struct("u", "v", F.lit(1).alias("up")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        ups, n = F.sum("up"), F.count("*")
        least = written(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), ((ups > 1) | ((ups > 0) & (ups < n))).alias("loose")), f"{folder}/{k}")
        if before:
            removed(spark, before)
        before = f"{folder}/{k}"
        if least.where("loose").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        few = least.count() <= broadcast_nodes
        short = F.broadcast if few else lambda df: df
        large = now.join(short(least.select(F.col("u").alias("v"), "m")), "v").select("u", F.col("m").alias("v")).where("u <> v")
        if not few:
            large = written(large.distinct(), before)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), before)
        small = large.join(short(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.*").where("u <> v").distinct(), f"{folder}/{k + 1}")
    raise RuntimeError("components have not settled")
