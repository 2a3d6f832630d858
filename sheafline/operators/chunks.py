"""Documents to chunk records: numbering, typing, flags, hashes, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line with its position, in document order; a null text has no lines."""
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def chunk_type(line: Column) -> Column:
    """'table' for a line of cells, else 'prose'."""
    return F.when(F.contains(line, F.lit("|")), "table").otherwise("prose")


def tokens(text: Column) -> Column:
    """Words of a text; none for blank or null. Trimmed first, so that the split needs no filter."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[ \t\n\x0B\f\r]+"))


def chunk_records(docs: DataFrame, page_lines: int = 10) -> DataFrame:
    """Chunk records with content-and-position ids doc::page::item::slice; slices count non-blank lines of a page from 0."""
    rows = lines(docs.select("doc_id", "source", "lang", "text")).filter(F.trim("line") != "")
    rows = rows.withColumn("page", F.floor(F.col("line_no") / page_lines))
    slot = Window.partitionBy("doc_id", "page").orderBy("line_no")
    rows = rows.withColumn("slice", F.row_number().over(slot) - 1)
    cid = F.concat(F.lit("doc"), F.col("doc_id"), F.lit("::p"), F.col("page"), F.lit("::ln"), F.col("line_no"), F.lit("::s"), F.col("slice"))
    return rows.select("doc_id", "source", "lang", "page", "slice", cid.alias("chunk_id"), chunk_type(F.col("line")).alias("chunk_type"), F.size(tokens(F.col("line"))).cast("long").alias("n_tokens"), F.sha2("line", 256).alias("text_hash"), "line")


def band(share: Column, low: float, high: float) -> Column:
    return F.when(share < low, "BELOW").when(share > high, "ABOVE").otherwise("IN BAND")


def tally(chunks: DataFrame, low: float = 0.50, high: float = 0.70) -> DataFrame:
    """Counts, distinct tables and the share of table chunks by source, by lang and in all, in one pass of grouping sets."""
    is_table = F.col("chunk_type") == "table"
    rows = chunks.withColumn("table_key", F.when(is_table, F.concat_ws("::", "doc_id", "page")))
    out = rows.groupingSets([[F.col("source")], [F.col("lang")], []], "source", "lang").agg(
        F.grouping_id().cast("long").alias("level"),
        F.count("*").alias("n_chunks"),
        F.count_if(is_table).alias("n_table"),
        F.countDistinct("table_key").alias("n_tables"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    share = F.coalesce(F.try_divide(F.col("n_table"), F.col("n_chunks")), F.lit(0.0))
    return out.withColumn("share", F.round(share, 6)).withColumn("branch", band(share, low, high))
