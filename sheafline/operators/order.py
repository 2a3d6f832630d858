"""Order-dependent operators: carry-down, islands, clustering, last record, prefix acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import checkpoints


def carry_down(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last non-null value up to and with each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gap_clusters(df: DataFrame, key: str, order: Sequence[str], position: Column, gap: float, name: str = "cluster") -> DataFrame:
    """Clusters 0, 1, ... of each key: a row more than gap after the one before it starts a new one."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((position - F.lag(position).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("_new_", new).withColumn(name, F.sum("_new_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new_")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Touching or overlapping intervals of a key become one: key, start, end, n."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new_", F.coalesce((F.col(start) > reach).cast("long"), F.lit(0)))
    rows = rows.withColumn("_island_", F.sum("_new_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(key, "_island_").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island_")


def runs(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Consecutive rows of equal value: key, run (from 0), value, n."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_new_", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("long"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("_new_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def last_records(log: DataFrame, key: Sequence[str], offset: str, fields: Sequence[str]) -> DataFrame:
    """The fields of the last record of each key in an append-only log; a partial aggregate, no sort."""
    return log.groupBy(*key).agg(*[F.max_by(f, offset).alias(f) for f in fields], F.count("*").alias("n_records"))


def accept_prefix(df: DataFrame, key: str, order: Sequence[str], ok: Column, n: int) -> DataFrame:
    """The first n acceptable rows of each key and every row looked at up to the n-th, with `accepted` and `seen` counts."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("accepted", ok).withColumn("seen", F.sum(F.col("accepted").cast("long")).over(w))
    return rows.filter((F.col("seen") < n) | ((F.col("seen") == n) & F.col("accepted")))


def neighbour_flip(df: DataFrame, key: str, order: Sequence[str], bad: Column) -> DataFrame:
    """Bad rows between two good neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_bad_", bad).withColumn("_b_", F.lag("_bad_").over(w)).withColumn("_a_", F.lead("_bad_").over(w))
    return rows.filter("_bad_ and not _b_ and not _a_").drop("_bad_", "_b_", "_a_")


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """df with numbers 0, 1, ... within each group, without a group in one task.

    Rows are dealt by ranges of (group, order), written once, and ranked within their range; a small table of counts
    (groups that meet in a range, summed over ranges) gives each its first number.
    """
    spark = df.sparkSession
    checkpoints(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, group, *order).withColumn("_p_", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy(group, "_p_").agg(F.count("*").alias("_n_"))
    before = Window.partitionBy(group).orderBy("_p_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g_"), F.col("_p_").alias("_q_"), F.coalesce(F.sum("_n_").over(before), F.lit(0)).alias("_s_"))
    rank = F.row_number().over(Window.partitionBy(group, "_p_").orderBy(*order))
    out = dealt.withColumn("_r_", rank).join(starts, F.col(group).eqNullSafe(F.col("_g_")) & (F.col("_p_") == F.col("_q_")))
    return out.withColumn(name, F.col("_s_") + F.col("_r_") - 1).drop("_p_", "_q_", "_g_", "_s_", "_r_")
