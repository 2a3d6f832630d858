"""Predicates, flags and exclusions over documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import tokens


def unique_pool(df: DataFrame, text: str, also: Column) -> DataFrame:
    """Rows whose text occurs once and for which `also` holds. Only hashes are shuffled."""
    once = df.groupBy(F.sha2(text, 256).alias("_h_")).agg(F.count("*").alias("_n_")).filter("_n_ = 1").select("_h_")
    return df.withColumn("_h_", F.sha2(text, 256)).drop(text).filter(also).join(once, "_h_", "left_semi").drop("_h_")


def bar_reasons(text: Column) -> Column:
    """Why a text may not be used as a question's source; empty: it may."""
    n = F.size(tokens(text))
    return F.array_compact(
        F.array(
            F.when(~text.rlike("^[A-Z]"), "no_own_title"),
            F.when(n < 20, "too_short"),
            F.when(F.regexp_count(text, F.lit("[#*$%&|<>]")) * 50 > n, "symbols"),
            F.when(F.contains(text, F.lit("|")), "table_text"),
        )
    )


def links(pages: DataFrame, disallow: tuple[str, ...]) -> DataFrame:
    """Distinct absolute links of each page without those that hold a disallowed part."""
    href = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))).alias("href"))
    for part in disallow:
        href = href.filter(~F.contains("href", F.lit(part)))
    root, folder = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.regexp_replace("url", "[^/]*$", "")
    link = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.startswith("href", F.lit("/")), F.concat(root, "href")).otherwise(F.concat(folder, "href"))
    return href.select("page_id", link.alias("link")).distinct()


def thin_unit_exclusion(pages: DataFrame, unit: str, max_words: int, max_share: float | None, page_cap: int) -> DataFrame:
    """Share of thin pages per unit and the status that follows; a missing threshold is refused."""
    if max_share is None:
        raise ValueError("the share threshold is not set")
    thin = ((F.col("n_words") <= max_words) & (F.col("n_links") >= 1)).cast("int")
    out = pages.groupBy(unit).agg(F.count("*").alias("n_pages"), F.sum(thin).alias("n_thin"), F.avg(thin).alias("_s_"))
    status = F.when((F.col("_s_") >= max_share) | (F.col("n_pages") > page_cap), "EXCLUDED").otherwise("ACTIVE")
    return out.select(unit, "n_pages", "n_thin", F.round("_s_", 6).alias("share"), status.alias("status"))


def self_containment(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    tail = F.substr(text, F.greatest(F.length(text) - 599, F.lit(1)), F.lit(600))
    return (
        F.when(F.size(lines) < 2, "unjudgeable")
        .when(~F.element_at(lines, 1).rlike("^[A-Z]"), "fail:title")
        .when(F.contains(F.lower(F.substring(text, 1, 600)), F.lit("continued")), "fail:continued")
        .when(~tail.rlike("[.!?]"), "fail:run_off")
        .otherwise("pass")
    )


def terms(text: Column, all_of: tuple[str, ...], any_of: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.forall(F.array(*map(F.lit, all_of)), lambda t: F.contains(low, t)) & F.exists(F.array(*map(F.lit, any_of)), lambda t: F.contains(low, t))


def spread(hits: DataFrame, unit: str, order: str, n: int) -> DataFrame:
    """n examples: the first hit of each unit before any second one."""
    k = F.row_number().over(Window.partitionBy(unit).orderBy(order))
    return hits.withColumn("_k_", k).orderBy(F.col("_k_") > 1, order).limit(n).drop("_k_")
