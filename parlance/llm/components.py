"""Connected components of an edge list, in the cluster.

Large-star and small-star steps in turn (Kiveris et al., "Connected components
in MapReduce and beyond", 2014).  Every step is a grouped minimum, which
combines before the shuffle, and an equi-join, which adaptive execution splits
where a hub is hot.  Each round is a written table, so lost executors cost a
task and never the lineage.  Nothing but two sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("u <> v").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _pairs(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: long) but the roots themselves.

    The root is the smallest node that edges reach.  Loops and repeated edges
    are allowed; an edge with a null end is none.
    """
    now = scratch.table(_pairs(edges.select("u", "v").dropna()))
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(sums)
        after = scratch.table(_small_star(_large_star(now)))
        scratch.drop(now)
        now = after
