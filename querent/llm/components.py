"""Connected components by alternating large-star and small-star steps.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.) Every
step is one aggregate and one join of edges with node minima; the minima are
written before the join, so both its sides are plain exchanges and a hub's
edges can be split by adaptive execution. The minima also tell when the edges
are a forest of stars, each around its least node, and then nothing is left to
do: jobs are many and small here, and each costs the driver. Nothing is gathered
on the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.shared import written


def _minima(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (u long, v long)."""
    cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _minima(both)
        # A star's centre has no lesser neighbour, and its other nodes have the centre alone.
        if not near.where("m < u and n > 1").count():
            break
        low = near.select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = _minima(large).drop("n")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        cur = written(small.where("u <> v").distinct(), "small")
    else:
        raise RuntimeError(f"components did not settle in {most} iterations")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
