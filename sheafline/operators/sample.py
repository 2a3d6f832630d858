"""Reproducible draws by digest order: the same rows in any engine, order and layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def draw_key(seed: str, salt: str, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), *[F.col(c).cast("string") for c in cols]))


def draw(df: DataFrame, n: int, seed: str, salt: str, key: str) -> DataFrame:
    """n rows without replacement (all if there are fewer); a top-n per task, then one of n rows each."""
    return df.orderBy(draw_key(seed, salt, key), key).limit(n)


def draw_strata(df: DataFrame, stratum: Sequence[str], n: int, seed: str, salt: str, key: str) -> DataFrame:
    """n rows of each stratum; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*stratum).orderBy(draw_key(seed, salt, key), key)
    return df.withColumn("_r_", F.row_number().over(w)).filter(F.col("_r_") <= n).drop("_r_")


def draw_capped(df: DataFrame, group: str, cap: int, n: int, seed: str, key: str) -> DataFrame:
    """At most cap rows of each group, then n of those in a second order."""
    return draw(draw_strata(df, [group], cap, seed, "cap", key), n, seed, "shuffle", key)


def primary_and_reserve(df: DataFrame, unit: str, source: str, key: str, n: int, reserve: int, supplement: int, seed: str) -> DataFrame:
    """One row per unit in one seeded order: the first n are primary, the next are reserve; each source without a primary row gets `supplement` more."""
    order = draw_key(seed, "unit", key)
    first = df.withColumn("_o_", order).withColumn("_k_", F.row_number().over(Window.partitionBy(unit).orderBy("_o_", key))).filter("_k_ = 1").drop("_k_")
    # Ranks are needed up to n + reserve only: a bounded top list, joined back by key.
    top = first.orderBy("_o_", key).limit(n + reserve)
    ranked = top.select(F.col(key).alias("_key_"), F.row_number().over(Window.orderBy("_o_", key)).alias("_n_"))  # n + reserve rows
    rows = first.join(F.broadcast(ranked), F.col(key) == F.col("_key_"), "left").withColumn("role", F.when(F.col("_n_") <= n, "primary").when(F.col("_n_").isNotNull(), "reserve"))
    covered = rows.filter("role = 'primary'").select(source).distinct()
    rest = rows.filter("role is null").join(covered, source, "left_anti")
    more = rest.withColumn("_s_", F.row_number().over(Window.partitionBy(source).orderBy("_o_", key))).filter(F.col("_s_") <= supplement).withColumn("role", F.lit("supplement"))
    return rows.filter("role is not null").select(key, unit, source, "role").unionByName(more.select(key, unit, source, "role"))


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at ranks round(i (m - 1) / (n - 1)), all if there are fewer; rows are numbered over ranges, so the table may be large."""
    rows = numbered(df.withColumn("_all_", F.lit(0)), "_all_", [order], "_i_")
    size = df.agg(F.count("*").alias("_m_"))  # one row
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * (F.col("_m_") - 1) / (n - 1)).cast("long"))
    return rows.join(F.broadcast(size)).filter((F.col("_m_") <= n) | F.array_contains(at, F.col("_i_"))).select(*df.columns)
