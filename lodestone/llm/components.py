"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, used_up


# The least neighbours are written out before they are joined back: with both sides of the join read from files, Spark
# can split the partition of a hub.


def _large_star(spark: SparkSession, e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialise(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    out = materialise(spark, both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    used_up(spark, low)
    return out


def _small_star(spark: SparkSession, e: DataFrame) -> DataFrame:
    low = materialise(spark, e.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = e.join(low, "a")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    out = materialise(spark, out.where(F.col("a") != F.col("b")).distinct(), "edges")
    used_up(spark, low)
    return out


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of an edge (a, b), the smallest node that it is connected with.

    Nodes are of any orderable type. Edges may repeat, point either way or join a node to itself; null ends are
    ignored. Without edges the result is empty. A hub's edges are reduced by a partial ``min`` and joined back by a
    join whose large partitions Spark may split, so no task holds a whole component. Each round is written out.
    """
    pair = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = pair.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    alone = pair.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("root"))
    e, before = materialise(spark, e, "edges"), None
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    for _ in range(max_rounds):
        big = _large_star(spark, e)
        used_up(spark, e)
        e = _small_star(spark, big)
        used_up(spark, big)
        now = mark(e)
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    star = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    hubs = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return star.unionByName(hubs).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
