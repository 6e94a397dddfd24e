"""Connected components over link tables of any size, without collecting links or members anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, settle

MOST_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable by links, for every id that has one.

    Alternates two steps until only stars are left: every node links its larger neighbours to the smallest node it knows, then
    every node links its smaller neighbours and itself to the smallest of them.  Both are a minimum per node, which Spark
    combines before the shuffle, and an equi-join that adaptive execution splits where a node is hot.  Each round is written to
    the shared folder, so a lost executor repeats one round at most.  Links with a null end and links to oneself are ignored.
    """
    edges = settle(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    for _ in range(MOST_ROUNDS):
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e")).select("e.*")
        roles = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
        if roles.filter("below > 1 OR (below > 0 AND above > 0)").isEmpty():
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            out = settle(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots))
            discard(edges)
            return out
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
        before, edges = edges, settle(small.filter("u <> v").distinct())
        discard(before)
    raise RuntimeError("components did not settle")
