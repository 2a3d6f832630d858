"""Matching of answers, claims and gold strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .chunks import tokens


def containment(items: DataFrame, item: str, docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(item, doc) where the item's text stands in the document's, without comparing all with all.

    A contained text of three words or more brings its inner words along whole.
    Each item is looked up by its longest inner word (documents offer their distinct words),
    then the strings are compared.  Shorter items are compared with every
    document; they must be few.
    """
    words = items.select(F.col(item).alias("item_id"), F.col(text).alias("gold"), tokens(F.col(text)).alias("w"))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    keyed = words.withColumn("key", F.when(F.size("w") > 2, F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]))
    long = keyed.filter("key is not null").select("item_id", "gold", "key")
    offered = docs.select(F.col(doc).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("key"))
    # Only (doc_id, word) pairs meet the items, and the engine sizes that join; then texts are fetched for candidates only.
    cand = offered.join(long, "key")
    body = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_body_"))
    found = cand.join(body, "doc_id").filter(F.contains("_body_", "gold")).select("item_id", "doc_id")
    short = keyed.filter("key is null").select("item_id", "gold")
    direct = body.join(short, F.contains("_body_", "gold")).select("item_id", "doc_id")
    return found.unionByName(direct).distinct()


def outcome(valid: Column, abstained: Column, hit: Column) -> Column:
    """invalid before abstained before hit or miss."""
    return F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(abstained, "abstained").when(hit, "hit").otherwise("miss")


def unshared_tokens(df: DataFrame, key: str, run: str, text: str = "text") -> DataFrame:
    """Per key: tokens that not every run holds (union less intersection)."""
    toks = df.select(key, run, F.explode(F.array_distinct(tokens(F.lower(text)))).alias("tok")).distinct()
    total = df.groupBy(key).agg(F.countDistinct(run).alias("_runs_"))
    each = toks.groupBy(key, "tok").agg(F.count("*").alias("_n_")).join(total, key)
    return each.filter("_n_ < _runs_").groupBy(key).agg(F.count("*").alias("n_unshared"))


def mean_jaccard(sets: DataFrame, key: str, run: str, items: str) -> DataFrame:
    """Mean Jaccard similarity over pairs of runs; two empty sets count as 1. Runs per key are few."""
    a = sets.select(key, F.col(run).alias("r1"), F.col(items).alias("a"))
    b = sets.select(F.col(key).alias("_k_"), F.col(run).alias("r2"), F.col(items).alias("b"))
    pairs = a.join(b, (F.col(key) == F.col("_k_")) & (F.col("r1") < F.col("r2")))
    j = F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), F.lit(1.0))
    return pairs.groupBy(key).agg(F.count("*").alias("n_pairs"), F.round(F.avg(j), 6).alias("jaccard"))


def guard_claims(claims: DataFrame, key: str, order: str, claim: str, early: Column) -> DataFrame:
    """reason (null: kept) and claim_id; a duplicate is one of an earlier kept claim of its key."""
    norm = F.lower(F.trim(fx.collapse(fx.normalize_numeric(F.col(claim)))))
    rows = claims.withColumn("_early_", early).withColumn("_norm_", norm)
    nth = F.row_number().over(Window.partitionBy(key, "_norm_", F.col("_early_").isNull()).orderBy(order))
    rows = rows.withColumn("_nth_", nth).withColumn("reason", F.coalesce("_early_", F.when(F.col("_nth_") > 1, "duplicate")))
    number = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(order)).cast("string")
    label = F.concat(F.when(F.col("reason").isNull(), "c").otherwise("x"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), "0"))
    return rows.withColumn("claim_id", label).drop("_early_", "_norm_", "_nth_")


def title_hits(items: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """The first document whose heading shares num/den of the smaller word set, per item. Items (item_id, w) meet headings (doc_id, x) by shared words."""
    want = items.select("item_id", F.size("w").alias("nw"), F.explode("w").alias("t"))
    have = heads.select("doc_id", F.size("x").alias("nx"), F.explode("x").alias("t"))
    shared = have.join(want, "t").groupBy("item_id", "doc_id", "nw", "nx").agg(F.count("*").alias("i"))
    return shared.filter(F.col("i") * den >= F.least("nw", "nx") * num).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
