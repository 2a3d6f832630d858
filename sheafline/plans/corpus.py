"""Corpus statistics, integrity, data quality and HTML sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import chunks as ch
from ..operators import integrity, quality
from .registry import query, table

CHUNKS_SQL = r"""
WITH exploded AS (
  SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents
), numbered AS (
  SELECT *, line_no // 10 AS page, row_number() OVER (PARTITION BY doc_id, line_no // 10 ORDER BY line_no) - 1 AS slice FROM exploded WHERE trim(line, ' ') <> ''
), chunks AS (
  SELECT doc_id, source, lang, page, slice, 'doc' || doc_id || '::p' || page || '::ln' || line_no || '::s' || slice AS chunk_id,
    CASE WHEN contains(line, '|') THEN 'table' ELSE 'prose' END AS chunk_type,
    len(list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::BIGINT AS n_tokens, sha256(line) AS text_hash, line
  FROM numbered
)
"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ch.chunk_records(table(spark, sf, "documents"))


@query(
    "tally_grouping_sets",
    CHUNKS_SQL
    + """SELECT source, lang, grouping(source, lang)::BIGINT AS level, count(*) AS n_chunks, count(*) FILTER (chunk_type = 'table') AS n_table,
  count(DISTINCT CASE WHEN chunk_type = 'table' THEN doc_id || '::' || page END) AS n_tables, count(DISTINCT doc_id) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens,
  round(count(*) FILTER (chunk_type = 'table') / count(*), 6) AS share,
  CASE WHEN count(*) FILTER (chunk_type = 'table') / count(*) < 0.5 THEN 'BELOW' WHEN count(*) FILTER (chunk_type = 'table') / count(*) > 0.7 THEN 'ABOVE' ELSE 'IN BAND' END AS branch
FROM chunks GROUP BY GROUPING SETS ((source), (lang), ())""",
)
def tally_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return ch.tally(_chunks(spark, sf))


@query("token_weighted_share", CHUNKS_SQL + "SELECT source, round(sum(CASE WHEN chunk_type = 'table' THEN n_tokens ELSE 0 END) / nullif(sum(n_tokens), 0), 6) AS share FROM chunks GROUP BY source")
def token_weighted_share(spark: SparkSession, sf: str) -> DataFrame:
    share = F.try_divide(F.sum(F.when(F.col("chunk_type") == "table", F.col("n_tokens")).otherwise(0)), F.sum("n_tokens"))
    return _chunks(spark, sf).groupBy("source").agg(F.round(share, 6).alias("share"))


@query("chunk_ids_and_slices", CHUNKS_SQL + "SELECT chunk_id, chunk_type, n_tokens, page::BIGINT AS page, slice::BIGINT AS slice FROM chunks")
def chunk_ids_and_slices(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", "chunk_type", "n_tokens", F.col("page").cast("long").alias("page"), F.col("slice").cast("long").alias("slice"))


@query("lock_hashes", "SELECT doc_id, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def lock_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "lock_diff_full_outer",
    """WITH a AS (SELECT doc_id AS pos, sha256(text) AS hash FROM documents), b AS (SELECT doc_id AS pos, sha256(CASE WHEN doc_id % 7 = 3 THEN text || ' ' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 5)
SELECT coalesce(a.pos, b.pos) AS pos, CASE WHEN a.pos IS NULL THEN 'extra' WHEN b.pos IS NULL THEN 'missing' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.pos = b.pos WHERE a.hash IS DISTINCT FROM b.hash""",
)
def lock_diff_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    have = docs.select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("hash"))
    other = docs.filter("doc_id % 11 <> 5").select(F.col("doc_id").alias("pos"), F.sha2(F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("hash"))
    return integrity.positional_diff(have, other, "pos", "hash")


@query(
    "input_refusals",
    """SELECT 'active_without_chunks' AS rule, CAST(l.doc_id AS VARCHAR) AS subject FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars >= 100) d USING (doc_id) WHERE l.quality = 1 AND d.doc_id IS NULL
UNION ALL SELECT 'chunks_of_inactive', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'duplicate_text', min(sha256(text)) FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'bad_character', CAST(doc_id AS VARCHAR) FROM documents WHERE contains(text, chr(8)) OR contains(text, chr(65533))
UNION ALL SELECT 'bad_source', CAST(doc_id AS VARCHAR) FROM documents WHERE NOT regexp_full_match(source, 'src[0-9]+')""",
)
def input_refusals(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.refusals(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("unique_text_pool", "SELECT doc_id FROM (SELECT doc_id, n_chars, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n = 1 AND n_chars > 20")
def unique_text_pool(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unique_pool(table(spark, sf, "documents"), "text", F.col("n_chars") > 20).select("doc_id")


BARS_SQL = """SELECT doc_id, concat_ws(',', CASE WHEN NOT regexp_matches(text, '^[A-Z]') THEN 'no_own_title' END, CASE WHEN n_words < 20 THEN 'too_short' END,
  CASE WHEN n_sym * 50 > n_words THEN 'symbols' END, CASE WHEN contains(text, '|') THEN 'table_text' END) AS reasons
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n_words, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_sym FROM documents)"""


@query("bar_reasons_array", f"SELECT doc_id, reasons, reasons <> '' AS barred FROM ({BARS_SQL})")
def bar_reasons_array(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "documents").select("doc_id", quality.bar_reasons(F.col("text")).alias("why"))
    return out.select("doc_id", F.array_join("why", ",").alias("reasons"), (F.size("why") > 0).alias("barred"))


@query("reasons_explode_distinct", f"SELECT reason, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM (SELECT doc_id, unnest(string_split(reasons, ',')) AS reason FROM ({BARS_SQL}) WHERE reasons <> '') JOIN documents USING (doc_id) GROUP BY reason")
def reasons_explode_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", F.explode(quality.bar_reasons(F.col("text"))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"))


@query(
    "eligibility_flags",
    """SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 200) AS n_long, count(*) FILTER (contains(text, chr(10))) AS n_multi,
  round(avg(CASE WHEN length(trim(text, ' ')) > 0 THEN 1.0 ELSE 0.0 END), 6) AS text_ratio, avg(CASE WHEN length(trim(text, ' ')) > 0 THEN 1.0 ELSE 0.0 END) < 0.95 AS low_text_layer FROM documents GROUP BY source""",
)
def eligibility_flags(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.avg((F.length(F.trim("text")) > 0).cast("double"))
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 200).alias("n_long"), F.count_if(F.contains("text", F.lit("\n"))).alias("n_multi"), F.round(ratio, 6).alias("text_ratio"), (ratio < 0.95).alias("low_text_layer")
    )


HTML_SQL = r"""WITH bare AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', chr(10), 'g') AS t FROM pages),
texts AS (SELECT page_id, url, html, trim(regexp_replace(t, '\s*\n\s*', chr(10), 'g'), chr(10) || ' ') AS text FROM bare)"""


@query("html_strip_text", HTML_SQL + " SELECT page_id, length(text)::BIGINT AS n_chars, md5(text) AS hash FROM texts")
def html_strip_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", fx.strip_html(F.col("html")).alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("hash"))


@query(
    "html_links",
    """SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href ELSE regexp_replace(url, '[^/]*$', '') || href END AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS href FROM pages) WHERE NOT contains(href, 'javascript:') AND NOT contains(href, 'mailto:')""",
)
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return quality.links(table(spark, sf, "pages"), disallow=("javascript:", "mailto:"))


@query(
    "image_only_style_exclusion",
    HTML_SQL + """, facts AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CASE WHEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) <= 150 AND len(regexp_extract_all(html, '<a ')) >= 1 THEN 1 ELSE 0 END AS thin FROM texts)
SELECT host, count(*) AS n_pages, sum(thin)::BIGINT AS n_thin, round(avg(thin), 6) AS share, CASE WHEN avg(thin) >= 0.25 THEN 'EXCLUDED' WHEN count(*) > 200 THEN 'EXCLUDED' ELSE 'ACTIVE' END AS status FROM facts GROUP BY host""",
)
def image_only_style_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.size(ch.tokens(fx.strip_html(F.col("html")))).alias("n_words"), F.regexp_count("html", F.lit("<a ")).alias("n_links"))
    return quality.thin_unit_exclusion(pages, "host", max_words=150, max_share=0.25, page_cap=200)


@query(
    "url_series_latest",
    """WITH keyed AS (SELECT page_id, regexp_replace(url, '[0-9]+', '', 'g') AS series, coalesce(TRY_CAST(regexp_extract(url, '([0-9]+)', 1) AS BIGINT), -1) AS edition FROM pages)
SELECT series, page_id, edition FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY edition DESC, page_id) AS rn FROM keyed) WHERE rn = 1""",
)
def url_series_latest(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", "").alias("series"), F.coalesce(F.regexp_extract("url", "([0-9]+)", 1).try_cast("long"), F.lit(-1)).alias("edition"))
    newest = Window.partitionBy("series").orderBy(F.desc("edition"), "page_id")
    return keyed.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").select("series", "page_id", "edition")


@query(
    "self_containment_verdicts",
    """WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS lines, lower(substr(text, 1, 600)) AS head, text FROM documents)
SELECT doc_id, CASE WHEN len(lines) < 2 THEN 'unjudgeable' WHEN NOT regexp_matches(lines[1], '^[A-Z]') THEN 'fail:title' WHEN contains(head, 'continued') THEN 'fail:continued'
  WHEN NOT regexp_matches(substr(text, greatest(length(text) - 599, 1), 600), '[.!?]') THEN 'fail:run_off' ELSE 'pass' END AS verdict FROM f""",
)
def self_containment_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", quality.self_containment(F.col("text")).alias("verdict"))


@query("term_filter_all_any", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND (contains(lower(text), 'license') OR contains(lower(text), 'tion') OR contains(lower(text), 'stupid'))")
def term_filter_all_any(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(quality.terms(F.col("text"), all_of=("the", "and"), any_of=("license", "tion", "stupid"))).select("doc_id")


@query("composition_not_exercised", "SELECT d.source, d.lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l USING (doc_id) WHERE x.source = d.source AND x.lang = d.lang) GROUP BY ALL")
def composition_not_exercised(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    seen = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("source", "lang").distinct()
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n")).join(seen, ["source", "lang"], "left_anti")


@query(
    "examples_spread",
    """WITH hits AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE contains(text, '|'))
SELECT doc_id, source FROM hits ORDER BY k > 1, doc_id LIMIT 5""",
)
def examples_spread(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").filter(F.contains("text", F.lit("|"))).select("doc_id", "source")
    return quality.spread(hits, "source", "doc_id", 5)


@query("dedup_keys", r"SELECT key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))) AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def dedup_keys(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "documents").select("doc_id", F.md5(F.lower(F.trim(fx.collapse(F.col("text"))))).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("custom_ids", "SELECT doc_id, substr(sha256(source || '|' || doc_id || '|' || lang), 1, 40) AS custom_id, count(*) OVER (PARTITION BY substr(sha256(source || '|' || doc_id || '|' || lang), 1, 40)) AS n_same FROM documents")
def custom_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", fx.custom_id("source", "doc_id", "lang").alias("custom_id"))
    return rows.withColumn("n_same", F.count("*").over(Window.partitionBy("custom_id")))


@query("character_census", "SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(regexp_replace(text, '[ -~\n\r\t]', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY lang, ch")
def character_census(spark: SparkSession, sf: str) -> DataFrame:
    chars = table(spark, sf, "documents").select("lang", F.explode(F.split(F.regexp_replace("text", "[ -~\n\r\t]", ""), "")).alias("ch"))
    return chars.filter("ch <> ''").groupBy("lang", "ch").agg(F.count("*").alias("n"))
