"""Content hashes, positional comparison and input refusals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positional_diff(have: DataFrame, other: DataFrame, pos: str, value: str) -> DataFrame:
    """Positions whose values differ: missing in other, extra in other, or changed."""
    a = have.select(F.col(pos).alias("p1"), F.col(value).alias("v1"))
    b = other.select(F.col(pos).alias("p2"), F.col(value).alias("v2"))
    both = a.join(b, F.col("p1") == F.col("p2"), "full").filter(~F.col("v1").eqNullSafe(F.col("v2")))
    kind = F.when(F.col("p1").isNull(), "extra").when(F.col("p2").isNull(), "missing").otherwise("changed")
    return both.select(F.coalesce("p1", "p2").alias(pos), kind.alias("kind"))


def two_way_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) of either side that the other lacks, with column side."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def changed_fields(a: DataFrame, b: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key and the comma-separated names of the columns that differ between two versions (null-safe)."""
    cols = [c for c in a.columns if c != key and c not in ignore]
    left = a.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(F.col(key).alias("_k_"), *[F.col(c).alias(f"b_{c}") for c in cols])
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in cols]))
    return left.join(right, F.col(key) == F.col("_k_")).select(key, F.array_join(differ, ",").alias("changed")).filter("changed <> ''")


def violations(df: DataFrame, rules: dict[str, Column], subject: str) -> DataFrame:
    """A row per broken rule and row; nothing is dropped or raised here."""
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(subject).cast("string").alias("subject"))


def refusals(docs: DataFrame, labels: DataFrame, min_chars: int = 100) -> DataFrame:
    """All reasons to refuse an input: every violation is listed, the caller decides."""
    active = labels.filter("quality = 1").select("doc_id")
    inactive = labels.filter("quality = 0").select("doc_id")
    long = docs.filter(F.col("n_chars") >= min_chars).select("doc_id")
    subject = F.col("doc_id").cast("string").alias("subject")
    parts = [
        active.join(long, "doc_id", "left_anti").select(F.lit("active_without_chunks").alias("rule"), subject),
        docs.join(inactive, "doc_id", "left_semi").select(F.lit("chunks_of_inactive").alias("rule"), subject),
        docs.groupBy(F.sha2("text", 256).alias("subject")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_text").alias("rule"), "subject"),
        violations(docs, {"bad_character": F.contains("text", F.lit("\b")) | F.contains("text", F.lit("�")), "bad_source": ~F.col("source").rlike("^src[0-9]+$")}, "doc_id"),
    ]
    return reduce(DataFrame.unionByName, parts)
