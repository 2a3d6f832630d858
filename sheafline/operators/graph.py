"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import checkpoints


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every vertex with an edge; component is the least id reachable.

    Rounds of large-star and small-star: every vertex hands the least of its neighbours and itself on to the
    greater, then to the lesser ones, until all point at their least.  A hub costs an aggregate, no list.
    """
    checkpoints(edges.sparkSession)
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct().checkpoint()
    while True:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")).checkpoint()
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct().checkpoint()
        down = large.groupBy("x").agg(F.min("y").alias("m")).checkpoint()
        small = large.join(down, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("s"))
        new = small.select("s.x", "s.y").filter("x <> y").distinct().checkpoint()
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    ends = e.select(F.col("x").alias("id"), F.col("y").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())
