"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; every shard has a weight, and a rack or
region weighs as much as its shards.  A key descends: at each level every child
of the node reached draws an exponential variate from a hash of (key, child),
with the child's weight as rate, and the least draw wins, so a child is chosen
with probability weight / sibling weights.  A changed weight touches only the
draws of the nodes on its path: at each level keys move only into (or out of)
the child whose weight changed, all other subtrees keep their keys.  A shard
that is added as a region of its own (`grown`) therefore takes keys only into
itself, and the others keep theirs.

Per row the cost is a hash and a logarithm for each child of the three nodes
passed, not for each shard.  All of it is one projection of built-in functions
over a literal tree.  Rows (key, size, crc, shard) are written once, so texts
are read once; only the slots shuffle.

Cases: a null key is drawn like any other value; a null text has no bytes
(size 1, crc 0); repeated rows go to one shard and get slots of their own, dealt
to parts like other rows; an empty table gives an empty table; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

SALTS = 512


class Shard(NamedTuple):
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def tree(n_shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """Equal shards in racks of per_rack and regions of racks."""
    return [Shard(i, f"r{i // (per_rack * racks)}", f"k{i // per_rack}") for i in range(n_shards)]


def grown(shards: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The shards and one more, which is a region of its own."""
    new = max((s.shard for s in shards), default=-1) + 1
    return [*shards, Shard(new, f"own {new}", "own", weight)]


def _nodes(shards: Sequence[Shard], levels: tuple[str, ...] = ("region", "rack"), path: str = "") -> Column:
    """array<struct<seed, weight, below>> of the children at this level; below: their children, or the shard."""
    if not levels:
        return F.array(*[F.struct(F.lit(f"{path}/{s.shard}").alias("seed"), F.lit(float(s.weight)).alias("weight"), F.lit(s.shard).alias("below")) for s in shards])
    parts: dict[str, list[Shard]] = {}
    for s in shards:
        parts.setdefault(getattr(s, levels[0]), []).append(s)
    return F.array(*[
        F.struct(F.lit(f"{path}/{name}").alias("seed"), F.lit(float(sum(s.weight for s in part))).alias("weight"), _nodes(part, levels[1:], f"{path}/{name}").alias("below"))
        for name, part in parts.items()
    ])


def _drawn(key: Column, nodes: Column) -> Column:
    """What is below the child with the least draw (the least name on a tie)."""

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["seed"]), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["seed"].alias("seed"), c["below"].alias("below"))

    return F.array_min(F.transform(nodes, draw))["below"]


def place(df: DataFrame, key: str, shards: Sequence[Shard], name: str) -> DataFrame:
    """df with column `name`: the shard that the descent reaches. Shards of weight 0 get nothing."""
    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("no shard has weight")
    k = F.col(key)
    return df.withColumn(name, _drawn(k, _drawn(k, _drawn(k, _nodes(live)))))


def gapless(df: DataFrame, group: str, order: Sequence[str], name: str, salts: int | Column = SALTS) -> DataFrame:
    """Numbers 0, 1, ... within each group without bringing a group together.

    df must be a table written before (see lineage): it is read twice, and rows
    are dealt to (group, salt) by their place in it, equal rows too.  A small
    table of counts (at most groups x salts rows) gives each part its first
    number.  salts may be an expression of the group.
    """
    df = df.withColumn("_salt_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts if isinstance(salts, Column) else F.lit(salts)).cast("int"))
    counts = df.groupBy(group, "_salt_").agg(F.count("*").alias("_n_"))
    before = Window.partitionBy(group).orderBy("_salt_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g_"), F.col("_salt_").alias("_s_"), F.coalesce(F.sum("_n_").over(before), F.lit(0)).alias("_start_"))
    rank = F.row_number().over(Window.partitionBy(group, "_salt_").orderBy(*order))
    out = df.withColumn("_rank_", rank).join(F.broadcast(starts), (F.col(group) == F.col("_g_")) & (F.col("_salt_") == F.col("_s_")))
    return out.withColumn(name, F.col("_start_") + F.col("_rank_") - 1).drop("_g_", "_s_", "_start_", "_rank_", "_salt_")


def shard_documents(docs: DataFrame, shards: Sequence[Shard], grown: Sequence[Shard] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, text_crc32, shard, slot within the shard, and the shard in the grown tree (null without one)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = place(rows, key, shards, "shard")
    rows = place(rows, key, grown, "grown_shard") if grown is not None else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return gapless(cut(rows), "shard", [key, "text_crc32", "size"], "slot")
