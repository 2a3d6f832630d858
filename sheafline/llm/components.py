"""Connected components of a distributed edge list, by hooking to the least neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that isn't the least of its component; component is that least id.

    Each round every vertex with a smaller neighbour hooks to the least of
    them; chains are shortened by doubling; edges are contracted to the new
    roots.  A hub costs a partial aggregate per task, never a collected list.
    Nulls and loops are no edges; no edges give no rows.  The result is a cut
    table; those of the steps are deleted.
    """
    e = cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    labels = cut(e.limit(0).select(F.col("hi").alias("id"), F.col("lo").alias("component")))
    while not e.isEmpty():
        parent = cut(e.groupBy("hi").agg(F.min("lo").alias("p"), F.lit(False).alias("moved")))
        while True:
            up = parent.select(F.col("hi").alias("_u_"), F.col("p").alias("_v_"))
            jump = cut(parent.join(up, F.col("p") == F.col("_u_"), "left").select("hi", F.coalesce("_v_", "p").alias("p"), F.col("_v_").isNotNull().alias("moved")))
            drop(parent)
            parent = jump
            if jump.filter("moved").isEmpty():
                break
        step = parent.select(F.col("hi").alias("_u_"), F.col("p").alias("_v_"))
        moved = e.join(step, F.col("hi") == F.col("_u_"), "left").select(F.coalesce("_v_", "hi").alias("x"), "lo")
        moved = moved.join(step, F.col("lo") == F.col("_u_"), "left").select("x", F.coalesce("_v_", "lo").alias("y")).filter("x != y")
        rest = cut(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
        old = labels.join(step, F.col("component") == F.col("_u_"), "left").select("id", F.coalesce("_v_", "component").alias("component"))
        new = cut(old.unionByName(parent.select(F.col("hi").alias("id"), F.col("p").alias("component"))))
        drop(e, parent, labels)
        e, labels = rest, new
    drop(e)
    return labels
