"""Joins that relational engines lack by name: multiset, division, nearest, overlap, as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import tokens


def multiset_match(wanted: DataFrame, printed: DataFrame, group: Sequence[str], value: str, order_wanted: str) -> DataFrame:
    """Rows of wanted with `admitted`: each printed copy of a value admits one wanted row of its group.

    Printed copies are only counted, so a value printed millions of times is
    one row; wanted rows are numbered per value and admitted up to the count.
    """
    keys = [*group, value]
    counts = printed.groupBy(*keys).agg(F.count("*").alias("_printed_"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order_wanted))
    out = wanted.withColumn("_nth_", nth).join(counts, keys, "left")
    return out.withColumn("admitted", F.coalesce(F.col("_nth_") <= F.col("_printed_"), F.lit(False))).drop("_nth_", "_printed_")


def multiset_overlap(a: DataFrame, b: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per group: values of a, those conserved in b (multiset intersection), and the excess."""
    keys = [*group, value]
    side = lambda df, x, y: df.select(*keys, F.lit(x).cast("long").alias("_x_"), F.lit(y).cast("long").alias("_y_"))
    counts = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*keys).agg(F.sum("_x_").alias("_a_"), F.sum("_y_").alias("_b_"))  # one shuffle of partial counts
    both = counts.filter("_a_ > 0").withColumn("_c_", F.least("_a_", "_b_"))
    return both.groupBy(*group).agg(F.sum("_a_").alias("n"), F.sum("_c_").alias("conserved"), F.sum(F.col("_a_") - F.col("_c_")).alias("excess"))


def line_overlap(df: DataFrame, key: str, text: str, dropped: str) -> DataFrame:
    """Per key: words of the texts, those conserved in a version without the lines that have the string `dropped`, and the excess.

    The version's words are a part of the text's, as no word goes beyond its line; so the intersection of the two
    multisets is the version itself and nothing is exploded or shuffled by word.  A key without words has no row.
    A null key equals no key, so its words meet none.
    """
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~F.contains(line, F.lit(dropped))), "\n")
    n, c = F.size(tokens(F.col(text))).cast("long"), F.size(tokens(kept)).cast("long")
    counts = df.select(key, n.alias("_n_"), F.when(F.col(key).isNull(), 0).otherwise(c).alias("_c_")).filter("_n_ > 0")
    return counts.groupBy(key).agg(F.sum("_n_").alias("n"), F.sum("_c_").alias("conserved"), F.sum(F.col("_n_") - F.col("_c_")).alias("excess"))


def divide(required: DataFrame, offered: DataFrame, req_key: str, off_key: str, item: str) -> DataFrame:
    """Pairs where every item of the required group is among the offered group's, with n_candidates per required group."""
    need = required.select(req_key, item).distinct()
    total = need.groupBy(req_key).agg(F.count("*").alias("_need_"))
    have = need.join(offered.select(off_key, item).distinct(), item).groupBy(req_key, off_key).agg(F.count("*").alias("_have_"))
    full = have.join(total, req_key).filter("_have_ = _need_").select(req_key, off_key)
    return full.withColumn("n_candidates", F.count("*").over(Window.partitionBy(req_key)))


def nearest(values: DataFrame, bands: DataFrame, value: str, band: str, centre: str) -> DataFrame:
    """The band whose centre is nearest (least band on ties), without a cross join: each value looks at the two centres around it.

    Bands must be few enough for one task each way; only they are ordered globally.
    """
    centres = bands.select(F.struct(F.col(centre).alias("c"), F.col(band).alias("b")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("_centres_"))
    at = F.aggregate("_centres_", F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).cast(bands.schema[band].dataType).alias("b")), lambda best, s: F.when(best["d"].isNull() | (F.abs(F.col(value) - s["c"]) < best["d"]) | ((F.abs(F.col(value) - s["c"]) == best["d"]) & (s["b"] < best["b"])), F.struct(F.abs(F.col(value) - s["c"]).cast("double").alias("d"), s["b"].alias("b"))).otherwise(best))
    return values.join(F.broadcast(centres)).withColumn(band, at["b"]).drop("_centres_")


def overlaps(a: DataFrame, b: DataFrame, key: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of one key whose intervals overlap. Both are cut at multiples of width, so the join is an equi-join; a pair is kept in its first common bin."""
    bins = lambda s: F.sequence(F.floor(F.col(s[0]) / width), F.floor(F.col(s[1]) / width))
    left, right = a.withColumn("_bin_", F.explode(bins(a_span))), b.withColumn("_bin_", F.explode(bins(b_span)))
    hit = left.join(right, [*key, "_bin_"]).filter((F.col(a_span[1]) > F.col(b_span[0])) & (F.col(a_span[0]) < F.col(b_span[1])))
    return hit.filter(F.col("_bin_") == F.floor(F.greatest(a_span[0], b_span[0]) / width)).drop("_bin_")


def asof_forward(df: DataFrame, key: str, order: Sequence[str], is_source: Column, is_target: Column, is_reset: Column, value: str) -> DataFrame:
    """Source rows with the value of the next target row of their key, null if a reset comes first."""
    after = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    hit = F.first(F.when(is_target | is_reset, F.struct(is_target.alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(after)
    rows = df.withColumn("_source_", is_source).withColumn("_hit_", hit).filter("_source_")
    return rows.withColumn(f"next_{value}", F.when(F.col("_hit_.t"), F.col("_hit_.v"))).drop("_source_", "_hit_")


def asof_backward(df: DataFrame, key: str, order: Sequence[str], is_source: Column, is_target: Column, is_barrier: Column, value: str) -> DataFrame:
    """Source rows with the value of the nearest target row before them, and whether a barrier lies between (then it isn't used)."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn("_n_", n)
    target = F.last(F.when(is_target, F.struct("_n_", value)), ignorenulls=True).over(before)
    barrier = F.last(F.when(is_barrier, F.col("_n_")), ignorenulls=True).over(before)
    rows = rows.withColumn("_t_", target).withColumn("_b_", barrier).filter(is_source)
    between = F.coalesce(F.col("_b_") > F.col("_t_._n_"), F.lit(False))
    return rows.withColumn("blocked", between).withColumn(f"last_{value}", F.when(~between, F.col(f"_t_.{value}"))).drop("_n_", "_t_", "_b_")
