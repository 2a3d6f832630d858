"""Layout queries: glyphs are set from document lines (one character is ten points wide)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, layout
from .registry import query, table


def glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """Monospaced glyphs of an order's lines: line number, quantity and price in columns."""
    li = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(_lines()))
    row = F.concat(F.rpad(F.concat(F.lit("item"), F.col("l_partkey").cast("string")), 14, " "), F.lpad(F.col("l_quantity").cast("int").cast("string"), 8, " "), F.lpad(F.col("l_linenumber").cast("string"), 8, " "))
    chars = li.select(F.col("l_orderkey").cast("string").alias("unit"), F.lit(0).alias("table_no"), "n", F.posexplode(F.split(row, "")).alias("i", "text")).filter("text <> ' '")
    return chars.select("unit", "table_no", "text", (F.col("i") * 10.0).alias("x0"), (F.col("i") * 10.0 + 9.9).alias("x1"), (F.col("n") * 12.0).alias("top"), (F.col("n") * 12.0 + 10).alias("bottom"), F.lit(10.0).alias("size"))


def _lines():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")


@query("glyph_to_cells")
def glyph_to_cells(spark: SparkSession, sf: str) -> DataFrame:
    return layout.tables_from_glyphs(glyphs(spark, sf))


@query("fuzzy_label_match")
def fuzzy_label_match(spark: SparkSession, sf: str) -> DataFrame:
    """Part names against the same with their last letter doubled."""
    parts = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 50).alias("k"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("label")).distinct()
    return layout.label_matches(parts, parts.withColumn("label", F.concat("label", F.substring("label", -1, 1))).distinct(), "k", "label")


@query("confirmed_label_match")
def confirmed_label_match(spark: SparkSession, sf: str) -> DataFrame:
    """Part names against abbreviated ones with rounded prices; every seventh has other prices, so its label alone is no match."""
    part = table(spark, sf, "part")
    price = lambda c: F.create_map(F.lit("2024"), c.cast("decimal(18,2)").cast("string"))
    served = part.select(F.floor(F.col("p_partkey") / 50).alias("k"), F.concat_ws(" ", F.lit("East"), "p_name", "p_brand", "p_type").alias("label"), price(F.col("p_retailprice")).alias("v"))
    shown = F.create_map(F.lit("2024"), (F.col("p_retailprice") + F.when(F.col("p_partkey") % 7 == 0, 5).otherwise(0)).cast("decimal(18,1)").cast("string"))
    printed = part.select(F.floor(F.col("p_partkey") / 50).alias("k"), F.concat_ws(" ", F.lit("E."), "p_name", "p_brand", "p_type").alias("label"), shown.alias("v"))
    return layout.label_matches(printed, served, "k", "label", "v")


@query("nfkc_units")
def nfkc_units(spark: SparkSession, sf: str) -> DataFrame:
    """Words are counted first, so each distinct one is normalised once."""
    words = table(spark, sf, "documents").select(F.explode(chunks.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("unit", layout.normal_unit("word")).groupBy("unit").agg(F.sum("n").alias("n"))


@query(
    "point_ids",
    """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc::' || doc_id)) AS h FROM documents)""",
)
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", layout.point_id(F.concat(F.lit("doc::"), F.col("doc_id").cast("string"))).alias("point_id"))


LEADERS = ("|Total ���|{}|", "|{} �� {}|�|", "|a \\| b��|x|", "|Sum \b ���|{}��|", "��|{}��a|��")


@query(
    "leader_run_strip",
    "SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN '|Total |' || q || '|' WHEN 1 THEN '|' || q || ' �� ' || q || '|�|' WHEN 2 THEN '|a \\| b|x|' WHEN 3 THEN '|Sum |' || q || '|' ELSE '��|' || q || 'a|��' END AS row FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity::BIGINT AS VARCHAR) AS q, (l_orderkey + l_linenumber) % 5 AS k FROM lineitem)",
)
def leader_run_strip(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("long").cast("string")
    row = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), q) for x in LEADERS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", layout.strip_leaders(row).alias("row"))


@query("cell_scores")
def cell_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Rebuilt cells against the values they were set from."""
    li = table(spark, sf, "lineitem").withColumn("row_no", F.row_number().over(_lines()) - 1)
    unit = F.col("l_orderkey").cast("string").alias("unit")
    truth = li.select(unit, "row_no", F.lit(1).alias("col_no"), F.col("l_quantity").cast("int").cast("string").alias("text")).unionByName(li.select(unit, "row_no", F.lit(2).alias("col_no"), F.col("l_linenumber").cast("string").alias("text")))
    return layout.score_cells(truth, layout.tables_from_glyphs(glyphs(spark, sf)).filter("status = 'rebuilt' and col_no > 0"), ["unit"])
