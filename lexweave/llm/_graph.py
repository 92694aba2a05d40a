"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._work import BROADCAST_ROWS, dropped, spread_join, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(spark: SparkSession, edges: DataFrame, large: bool, n: int) -> DataFrame:
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("c"))
    # A node may have most edges: the least neighbours are sent to all executors, or the node's edges are dealt out.
    if 2 * n <= BROADCAST_ROWS:
        joined = both.join(F.broadcast(least.drop("c")), "a")
    else:
        least = written(least, spark)
        joined = spread_join(both, least, "a")
    moved = joined.filter((F.col("b") > F.col("a")) if large else (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return written(moved.filter("a <> b").distinct(), spark)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges``: a, b of bigint. Returns id, component for every id that an edge names, as a written table.

    component is the smallest id reachable. Each step is a few aggregations over the edges, the
    number of steps grows with the logarithm of the longest path, and each is written out.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), spark)
    mark = _mark(now)
    while mark[0]:
        wide = _star(spark, now, True, mark[0])
        then = _star(spark, wide, False, mark[0])
        new = _mark(then)
        dropped(now, wide)
        now = then
        if new == mark:
            break
        mark = new
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = written(ids.union(ids.select("component", "component").distinct()).groupBy("id").agg(F.min("component").alias("component")), spark)
    dropped(now)
    return out
