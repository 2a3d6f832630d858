"""Record-level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, records
from .registry import query, table

NOTES = "CASE WHEN doc_id % 9 = 0 THEN ['UNFETCHABLE: gone'] WHEN doc_id % 4 = 0 THEN ['checked'] ELSE [] END"


@query("counted_units", f"SELECT source, count(*) AS n FROM documents WHERE n_chars >= 50 AND len(list_filter({NOTES}, lambda x: contains(x, 'UNFETCHABLE'))) = 0 GROUP BY source")
def counted_units(spark: SparkSession, sf: str) -> DataFrame:
    notes = F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("UNFETCHABLE: gone"))).when(F.col("doc_id") % 4 == 0, F.array(F.lit("checked"))).otherwise(F.array().cast("array<string>"))
    units = table(spark, sf, "documents").select("source", "n_chars", notes.alias("notes"), F.when(F.col("n_chars") >= 50, "ACTIVE").otherwise("EXCLUDED").alias("status"))
    return records.counted(units).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "chunk_typing",
    "WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(x, '|') THEN 'table' WHEN length(x) < 60 THEN 'caption' ELSE 'text' END) AS t FROM documents) SELECT doc_id, CASE WHEN list_contains(t, 'table') AND NOT list_contains(t, 'text') THEN 'table' ELSE 'prose' END AS kind, list_contains(t, 'table') AND list_contains(t, 'text') AS mixed FROM l",
)
def chunk_typing(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.transform(F.split("text", "\n", -1), lambda x: F.when(F.contains(x, F.lit("|")), "table").when(F.length(x) < 60, "caption").otherwise("text"))
    return table(spark, sf, "documents").select("doc_id", records.table_typing(kinds).alias("t")).select("doc_id", "t.kind", "t.mixed")


@query("parse_path_of_order", "SELECT l_orderkey, CASE WHEN list_contains(list(p), 'fallback') THEN 'fallback' ELSE arg_min(p, (l_linenumber, l_partkey, l_suppkey)) END AS path FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'fallback' WHEN l_linestatus = 'O' THEN 'rebuilt' ELSE 'kept' END AS p FROM lineitem) GROUP BY l_orderkey")
def parse_path_of_order(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("l_returnflag") == "R", "fallback").when(F.col("l_linestatus") == "O", "rebuilt").otherwise("kept")
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", p.alias("p")))).alias("s"))  # the lines of one order
    return parts.select("l_orderkey", records.parse_path(F.transform("s", lambda x: x["p"])).alias("path"))


@query("key_set_check", "SELECT *, only_a = 0 AND only_b = 0 AS equal FROM (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_a, (SELECT count(DISTINCT doc_id) FROM labels) AS n_b, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_b, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_a)")
def key_set_check(spark: SparkSession, sf: str) -> DataFrame:
    return records.same_sets(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query(
    "texts_in_rank_order",
    "WITH h AS (SELECT conv_id, unnest([conv_id * 3 % 50, conv_id * 7 % 50, 999999 + conv_id]) AS id, unnest([0, 1, 2]) AS pos FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id, md5(string_agg(coalesce(text, ''), '|' ORDER BY pos)) AS hash, count(*) FILTER (text IS NULL) AS n_missing FROM h LEFT JOIN documents ON doc_id = id GROUP BY conv_id",
)
def texts_in_rank_order(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    hits = table(spark, sf, "conversations").select("conv_id").distinct().withColumn("ids", F.array(c * 3 % 50, c * 7 % 50, c + 999999))
    out = records.texts_in_rank_order(hits, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "conv_id", "ids", "text")
    return out.select("conv_id", F.md5(F.array_join(F.transform("texts", lambda t: F.coalesce(t, F.lit(""))), "|")).alias("hash"), "n_missing")


@query(
    "fail_aggregation",
    "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'FAIL' ELSE 'ok' END AS status, CASE WHEN NOT bool_or(o_orderstatus = 'P') THEN max(o_totalprice) END AS p, coalesce(string_agg(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, '; ' ORDER BY o_orderkey), '') AS reasons FROM orders GROUP BY o_custkey",
)
def fail_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("ok"))
    return records.failing(calls, ["o_custkey"], "status", "o_totalprice", "o_orderpriority", "o_orderkey")


@query(
    "majority_column_map",
    """WITH v AS (SELECT l_linestatus, l_suppkey, l_linenumber AS band, count(*) AS n, min(l_orderkey) AS o FROM lineitem GROUP BY ALL), b AS (SELECT l_linestatus, l_suppkey, arg_max(band, (n, -band)) AS band, min(o) AS o FROM v GROUP BY ALL)
SELECT l_linestatus, l_suppkey, band, row_number() OVER (PARTITION BY l_linestatus, band ORDER BY o, l_suppkey) = 1 AS kept FROM b""",
)
def majority_column_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_linestatus", "l_suppkey", F.col("l_linenumber").alias("band"), "l_orderkey")
    return records.majority_map(rows, ["l_linestatus", "l_suppkey"], "band", "l_orderkey")


BOX = "{c}_custkey % 37 AS {p}0, {c}_custkey % 23 AS {p}1, {c}_custkey % 37 + 5 AS {p}2, {c}_custkey % 23 + 4 AS {p}3"


@query(
    "box_match_iou",
    """WITH a AS (SELECT s_suppkey, (s_suppkey % 37)::DOUBLE AS x, (s_suppkey % 23)::DOUBLE AS y, s_nationkey AS k FROM supplier), b AS (SELECT c_custkey, (c_custkey % 37)::DOUBLE AS u, (c_custkey % 23)::DOUBLE AS v, c_nationkey AS k FROM customer),
m AS (SELECT s_suppkey, c_custkey, greatest(0, least(x + 5, u + 5) - greatest(x, u)) * greatest(0, least(y + 4, v + 4) - greatest(y, v)) AS i FROM a JOIN b USING (k))
SELECT s_suppkey, arg_max(c_custkey, (i / (40 - i), -c_custkey)) AS c_custkey, round(max(i / (40 - i)), 6) AS iou FROM m GROUP BY s_suppkey""",
)
def box_match_iou(spark: SparkSession, sf: str) -> DataFrame:
    box = lambda c: [(F.col(c) % 37).cast("double"), (F.col(c) % 23).cast("double"), (F.col(c) % 37).cast("double") + 5, (F.col(c) % 23).cast("double") + 4]
    pairs = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")).join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), "k")
    scored = pairs.select("s_suppkey", "c_custkey", records.iou(box("s_suppkey"), box("c_custkey")).alias("i"))
    return scored.groupBy("s_suppkey").agg(F.max_by("c_custkey", F.struct(F.col("i"), -F.col("c_custkey"))).alias("c_custkey"), F.round(F.max("i"), 6).alias("iou"))


@query(
    "granule_gate",
    r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS v FROM documents), c AS (SELECT *, len(v) AS n, len(list_filter(v, lambda x: len(regexp_extract_all(x, '[0-9]+')) >= 3)) AS num, len(list_filter(v[1:5], lambda x: contains(x, '|'))) AS h, len(list_filter(v[greatest(1, len(v) - 4):greatest(1, len(v) - 4) + 4], lambda x: contains(x, '|'))) AS t FROM l)
SELECT doc_id, CASE WHEN n = 0 THEN 'field-absent' WHEN num >= 3 AND NOT regexp_matches(lower(text), 'percent|million|billion|dollars') THEN 'fail:units' WHEN t >= 5 AND h >= 5 THEN 'flag:boundary' ELSE 'pass' END AS gate FROM c""",
)
def granule_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", records.granule_gate(F.col("text")).alias("gate"))


@query("question_checks", r"SELECT conv_id, turn, n BETWEEN 8 AND 40 AS length_ok, contains(text, '?') AS asks FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n FROM conversations) WHERE role = 'user'")
def question_checks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.size(chunks.tokens(F.col("text"))).between(8, 40).alias("length_ok"), F.contains("text", F.lit("?")).alias("asks"))


@query("relabel_overrides", "SELECT l.doc_id, coalesce(r.quality, l.quality) AS quality, r.doc_id IS NOT NULL AS changed FROM labels l LEFT JOIN (SELECT doc_id, 1 - quality AS quality FROM labels WHERE doc_id % 10 = 0) r USING (doc_id)")
def relabel_overrides(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    again = lab.filter("doc_id % 10 = 0").select("doc_id", (1 - F.col("quality")).alias("q2"))
    return lab.join(again, "doc_id", "left").select("doc_id", F.coalesce("q2", "quality").alias("quality"), F.col("q2").isNotNull().alias("changed"))


@query("cited_within_supplied", "SELECT o_orderkey, len(list_filter(list_distinct(list(l_suppkey)), lambda x: x > 5)) = 0 AS within, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def cited_within_supplied(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey")
    rows = o.join(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    outside = F.array_except(F.collect_set("l_suppkey"), F.array(*[F.lit(i).cast("long") for i in range(0, 6)]))
    return rows.groupBy("o_orderkey").agg((F.size(outside) == 0).alias("within"), F.count("*").alias("n"))


@query("cells_by_questions", "SELECT r_name AS cell, seed, count(*) AS n FROM region CROSS JOIN range(2) t(seed) CROSS JOIN (SELECT DISTINCT conv_id FROM conversations) GROUP BY ALL")
def cells_by_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every (cell, seed, question) key; cells and seeds are a small fixed design, exploded onto the questions."""
    cells = [r.r_name for r in table(spark, sf, "region").collect()]  # the design, a few rows
    q = table(spark, sf, "conversations").select("conv_id").distinct()
    keys = q.withColumn("cell", F.explode(F.array(*map(F.lit, cells)))).withColumn("seed", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return keys.groupBy("cell", "seed").agg(F.count("*").alias("n"))


@query("split_half_sets", "SELECT half, count(*) AS n, count(DISTINCT conv_id) AS n_questions FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS half FROM conversations) GROUP BY half")
def split_half_sets(spark: SparkSession, sf: str) -> DataFrame:
    half = F.when(F.col("turn") % 2 == 0, "a").otherwise("b")
    return table(spark, sf, "conversations").groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_questions"))


@query("softmax_pairs", "SELECT vec_id, round(1 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)), 6) AS p FROM embeddings")
def softmax_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(e[1].cast("double") - e[0].cast("double"))), 6).alias("p"))


@query("unit_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding)::BIGINT AS dim FROM embeddings")
def unit_norms(spark: SparkSession, sf: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm, 5).alias("norm"), F.size("embedding").cast("long").alias("dim"))


@query("altered_digits", r"SELECT o_orderkey, substr(s, 1, length(s) - 1) || ((CAST(right(s, 1) AS INT) + 1) % 10) AS altered FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s FROM orders)")
def altered_digits(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.substr(s, F.lit(1), F.length(s) - 1), ((F.right(s, F.lit(1)).cast("int") + 1) % 10).cast("string")).alias("altered"))


@query("pattern_coverage_pick", "SELECT pattern, min(doc_id) AS doc_id, count(*) AS n FROM (VALUES ('%License%'), ('%|%'), ('%@%')) p(pattern) JOIN documents ON text LIKE pattern GROUP BY pattern")
def pattern_coverage_pick(spark: SparkSession, sf: str) -> DataFrame:
    patterns = F.filter(F.array(*[F.when(F.col("text").like(p), p) for p in ("%License%", "%|%", "%@%")]), lambda x: x.isNotNull())
    return table(spark, sf, "documents").select("doc_id", F.explode(patterns).alias("pattern")).groupBy("pattern").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    "output_assertions",
    r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS v FROM documents) SELECT doc_id, regexp_matches(v[1], '^[A-Z]') AS starts_with_header, len(list_filter(v, lambda x: contains(x, '|'))) AS n_pipe_lines, len(list_filter(v, lambda x: trim(x, ' ') = '')) AS n_blank, starts_with(text, v[1]) AS prefix_intact FROM l""",
)
def output_assertions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.split("text", "\n", -1)
    first = F.element_at(v, 1)
    n = lambda cond: F.size(F.filter(v, cond)).cast("long")
    return table(spark, sf, "documents").select("doc_id", first.rlike("^[A-Z]").alias("starts_with_header"), n(lambda x: F.contains(x, F.lit("|"))).alias("n_pipe_lines"), n(lambda x: F.trim(x) == "").alias("n_blank"), F.startswith("text", first).alias("prefix_intact"))


@query("header_row_cause", "SELECT o_orderkey, CASE WHEN l_returnflag = 'R' THEN 'caption_on_slice0' WHEN l_quantity > 45 THEN 'header_over_max' ELSE 'unclassified' END AS cause FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS slice FROM lineitem) ON l_orderkey = o_orderkey AND slice = 0")
def header_row_cause(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).alias("s"))
    cause = F.when(F.col("s.l_returnflag") == "R", "caption_on_slice0").when(F.col("s.l_quantity") > 45, "header_over_max").otherwise("unclassified")
    return table(spark, sf, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", cause.alias("cause"))


@query("shape_twins", "WITH s AS (SELECT o_orderkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_cols FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT n_rows, n_cols, count(*) AS twins, min(o_orderkey) AS first_key FROM s GROUP BY ALL HAVING count(*) > 1")
def shape_twins(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n_rows"), F.countDistinct("l_suppkey").alias("n_cols"))
    return s.groupBy("n_rows", "n_cols").agg(F.count("*").alias("twins"), F.min("o_orderkey").alias("first_key")).filter("twins > 1")


@query("batch_candidates", "WITH k AS (SELECT l_orderkey, count(*) AS n, md5(string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR))) AS ids FROM lineitem GROUP BY 1) SELECT ids, n, count(*) AS n_batches, count(*) > 1 AS ambiguous FROM k GROUP BY ids, n")
def batch_candidates(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.md5(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ","))
    k = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), ids.alias("ids"))
    return k.groupBy("ids", "n").agg(F.count("*").alias("n_batches")).withColumn("ambiguous", F.col("n_batches") > 1)


@query("not_in_manifest", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def not_in_manifest(spark: SparkSession, sf: str) -> DataFrame:
    manifest = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select("l_partkey")
    return table(spark, sf, "part").select("p_partkey").join(manifest, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("orphans_both_ways", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, CASE WHEN c_nationkey IS NULL THEN 'supplier only' ELSE 'customer only' END AS side FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 20) FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey > 4) ON c_nationkey = s_nationkey WHERE c_nationkey IS NULL OR s_nationkey IS NULL")
def orphans_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").filter("c_nationkey < 20").select("c_nationkey").distinct()
    b = table(spark, sf, "supplier").filter("s_nationkey > 4").select("s_nationkey").distinct()
    both = a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full").filter("c_nationkey is null or s_nationkey is null")
    return both.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.when(F.col("c_nationkey").isNull(), "supplier only").otherwise("customer only").alias("side"))


@query("results_by_key", "SELECT c_custkey, coalesce(max(o_orderstatus), 'errored') AS result FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def results_by_key(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("r"))
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("r", F.lit("errored")).alias("result"))


@query(
    "near_duplicate_groups",
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) > 0.9 * a.n * b.n), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT id, coalesce(n, 0) AS n_links, component, coalesce(rejected, false) AS rejected FROM (SELECT a AS id, min(b) AS component FROM r GROUP BY a) LEFT JOIN (SELECT a AS id, count(*) AS n, min(b) < a AS rejected FROM l GROUP BY a) USING (id)""",
)
def near_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with its links, its group and whether an earlier one rejects it."""
    from ..operators import retrieval as rt

    return rt.near_groups(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.9)


@query("markdown_report", "SELECT CASE WHEN i < 0 THEN i + 2 ELSE i + 2 END AS line_no, line FROM (SELECT -2 AS i, '| l_returnflag | l_linestatus | n |' AS line UNION ALL SELECT -1, '| --- | --- | --- |' UNION ALL SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus) - 1, '| ' || l_returnflag || ' | ' || l_linestatus || ' | ' || n || ' |' FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL))")
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import files

    return files.markdown_table(table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), ["l_returnflag", "l_linestatus"])
