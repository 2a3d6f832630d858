"""Draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sample
from .registry import query, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang")


@query("hash_sample", "SELECT doc_id, source FROM documents ORDER BY md5('20:all:' || doc_id), doc_id LIMIT 50")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.draw(_docs(spark, sf), 50, "20", "all", "doc_id").select("doc_id", "source")


@query("stratified_sample", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('20:strata:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.draw_strata(_docs(spark, sf), ["source", "lang"], 3, "20", "strata", "doc_id")


@query("capped_sample", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('20:cap:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 2 ORDER BY md5('20:shuffle:' || o_orderkey), o_orderkey LIMIT 100")
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.draw_capped(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 2, 100, "20", "o_orderkey")


@query(
    "primary_reserve_supplement",
    """WITH f AS (SELECT * FROM (SELECT p_partkey, p_name, p_brand, md5('20:unit:' || p_partkey) AS o, row_number() OVER (PARTITION BY p_name ORDER BY md5('20:unit:' || p_partkey), p_partkey) AS k FROM part) WHERE k = 1),
r AS (SELECT *, row_number() OVER (ORDER BY o, p_partkey) AS n FROM f), x AS (SELECT *, CASE WHEN n <= 8 THEN 'primary' WHEN n <= 14 THEN 'reserve' END AS role FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY o, p_partkey) AS z FROM x WHERE role IS NULL AND p_brand NOT IN (SELECT p_brand FROM x WHERE role = 'primary'))
SELECT p_partkey, p_name, p_brand, role FROM x WHERE role IS NOT NULL UNION ALL SELECT p_partkey, p_name, p_brand, 'supplement' FROM s WHERE z <= 2""",
)
def primary_reserve_supplement(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return sample.primary_and_reserve(parts, "p_name", "p_brand", "p_partkey", 8, 6, 2, "20")


@query("evenly_spaced_sample", "SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS m FROM nation) WHERE i IN (SELECT round(j * (m - 1) / 6.0) FROM range(7) t(j))")
def evenly_spaced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.evenly_spaced(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


@query("top_k_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top_k_group(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "disagreements_and_agreements",
    """WITH s AS (SELECT doc_id, quality, toxic, abs(quality - (doc_id % 100) / 100.0) AS gap FROM labels)
SELECT doc_id, kind FROM (SELECT doc_id, 'disagree' AS kind FROM s WHERE quality = toxic ORDER BY gap DESC, doc_id LIMIT 10) UNION ALL SELECT doc_id, kind FROM (SELECT doc_id, 'agree' AS kind FROM s WHERE quality <> toxic ORDER BY md5('20:agree:' || doc_id), doc_id LIMIT 10)""",
)
def disagreements_and_agreements(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    s = table(spark, sf, "labels").withColumn("gap", F.abs(F.col("quality") - (F.col("doc_id") % 100) / 100.0))
    worst = s.filter("quality = toxic").orderBy(F.desc("gap"), "doc_id").limit(10).select("doc_id", F.lit("disagree").alias("kind"))
    return worst.unionByName(sample.draw(s.filter("quality <> toxic"), 10, "20", "agree", "doc_id").select("doc_id", F.lit("agree").alias("kind")))
