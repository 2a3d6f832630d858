"""Summaries, guards and queues of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import records, stats
from .agreement import BASE, BOOT_SQL, DRAW, EXACT_SQL, _rated
from .registry import query, table


@query(
    "review_quota",
    "WITH l AS (SELECT conv_id, max(turn) AS turn, arg_max(length(text), turn) AS n FROM conversations GROUP BY conv_id), d AS (SELECT conv_id % 10 AS lot, count(*) FILTER (n >= 120) AS decided FROM l GROUP BY 1) SELECT conv_id, turn FROM l JOIN d ON lot = conv_id % 10 WHERE n < 120 AND decided < 4",
)
def review_quota(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of each item, undecided ones only; a lot whose quota of decided items is full asks for no more."""
    last = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.length("text"), "turn").alias("n"))
    return records.review_queue(last.withColumn("lot", F.col("conv_id") % 10), "lot", F.col("n") >= 120, 4).select("conv_id", "turn")


@query("cost_by_source", "SELECT source, sum(ceil(n_chars / 2000.0))::BIGINT AS pages, round(sum(ceil(n_chars / 2000.0)) * 0.0015, 6) AS low_usd, round(sum(ceil(n_chars / 2000.0)) * 0.01, 6) AS high_usd, round(sum(ceil(n_chars / 2000.0)) / 0.081 / 3600, 6) AS hours FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def cost_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 2,000 characters at a low and a high rate, and hours at 0.081 pages a second."""
    pages = F.sum(F.ceil(F.col("n_chars") / 2000.0).cast("long"))
    out = table(spark, sf, "documents").filter("n_chars is not null").groupBy("source").agg(pages.alias("pages"))
    return out.select("source", "pages", F.round(F.col("pages") * 0.0015, 6).alias("low_usd"), F.round(F.col("pages") * 0.01, 6).alias("high_usd"), F.round(F.col("pages") / 0.081 / 3600, 6).alias("hours"))


@query(
    "paired_bootstrap_ci",
    BOOT_SQL.format(rounds=1000, sums="count(*) AS n, sum(bad) AS x, sum(toxic) AS y,", base=BASE, draw=DRAW, value="(sum(x) - sum(y))::DOUBLE / nullif(sum(n), 0)")
    + " SELECT round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high, count(*) FILTER (rate IS NULL) AS undefined FROM s",
)
def paired_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of two rates under the same 1,000 resamples."""
    clusters = _rated(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("bad").alias("x"), F.sum("toxic").alias("y"))
    rows = stats.cluster_resamples(clusters, "source", 1000, ["n", "x", "y"]).withColumn("d", F.try_divide(F.col("x") - F.col("y"), F.col("n")))
    return stats.percentile_interval(rows, [], "d").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "undefined")


@query(
    "family_summary",
    "SELECT l_shipmode, n, hits, forced, round(hits::DOUBLE / nullif(n, 0), 6) AS rate, round(hits::DOUBLE / nullif(n + forced, 0), 6) AS conservative FROM (SELECT l_returnflag AS l_shipmode, count(*) FILTER (l_linenumber <= 6) AS n, count(*) FILTER (l_linenumber <= 6 AND l_discount >= 0.05) AS hits, count(*) FILTER (l_linenumber > 6) AS forced FROM lineitem GROUP BY 1)".replace("l_shipmode", "family"),
)
def family_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Exact share of the scored cells, and with cells that could not be scored counted as misses."""
    scored, n = F.col("l_linenumber") <= 6, F.count_if
    out = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("family")).agg(n(scored).alias("n"), n(scored & (F.col("l_discount") >= 0.05)).alias("hits"), n(~scored).alias("forced"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("hits"), F.col("n")), 6)).withColumn("conservative", F.round(F.try_divide(F.col("hits"), F.col("n") + F.col("forced")), 6))


@query(
    "rate_distribution",
    "WITH r AS (SELECT l_suppkey, 100.0::DOUBLE * count(*) FILTER (l_quantity > 10) / count(*) AS p FROM lineitem GROUP BY 1) SELECT CASE WHEN p >= 100 THEN '100' WHEN p >= 90 THEN '90-100' WHEN p >= 80 THEN '80-90' ELSE 'below 80' END AS bucket, count(*) AS n, round(min(p), 6) AS least, round(median(p), 6) AS median, round(avg(p), 6) AS mean FROM r GROUP BY 1",
)
def rate_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Units by their share of exact cells."""
    p = 100.0 * F.count_if(F.col("l_quantity") > 10) / F.count("*")
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(p.alias("p"))
    bucket = F.when(F.col("p") >= 100, "100").when(F.col("p") >= 90, "90-100").when(F.col("p") >= 80, "80-90").otherwise("below 80")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("least"), F.round(F.median("p"), 6).alias("median"), F.round(F.avg("p"), 6).alias("mean"))


@query(
    "median_tolerances",
    "WITH m AS (SELECT l_suppkey, median(l_quantity) / 2 AS tol, median(l_quantity) AS mid FROM lineitem GROUP BY 1) SELECT l_suppkey, round(tol, 6) AS tolerance, count(*) FILTER (abs(l_quantity - mid) > tol) AS n_outside FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey, tol",
)
def median_tolerances(spark: SparkSession, sf: str) -> DataFrame:
    """Half the median as tolerance, and the values that lie farther from it."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    mid = li.groupBy("l_suppkey").agg(F.median("l_quantity").alias("mid"))
    far = F.abs(F.col("l_quantity") - F.col("mid")) > F.col("mid") / 2
    return li.join(mid, "l_suppkey").groupBy("l_suppkey", F.round(F.col("mid") / 2, 6).alias("tolerance")).agg(F.count_if(far).alias("n_outside"))


@query(
    "wide_rows",
    r"""WITH l AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), h AS (SELECT doc_id, n AS head FROM l WHERE i = 1)
SELECT doc_id, count(*) FILTER (n + head > 60) AS n_wide, max(n + head) AS widest FROM l JOIN h USING (doc_id) WHERE i > 1 GROUP BY doc_id""",
)
def wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that with their header, the first line, have more than 60 words."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.size(F.filter(F.split(x, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long"))
    rows = table(spark, sf, "documents").filter("text is not null").select("doc_id", lines.alias("n")).filter(F.size("n") > 1)
    both = F.transform(F.slice("n", F.lit(2), F.size("n") - 1), lambda x: x + F.col("n")[0])
    return rows.groupBy("doc_id").agg(F.sum(F.size(F.filter(both, lambda x: x > 60))).cast("long").alias("n_wide"), F.max(F.array_max(both)).alias("widest"))


@query("controls_by_kind", EXACT_SQL.format(key="role", counts="SELECT role AS key, count(*) AS n, count(*) FILTER (length(text) < 60) AS k FROM conversations GROUP BY role"))
def controls_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Abstained controls (short answers) by kind, with exact intervals."""
    c = table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 60).alias("k"))
    return c.withColumn("w", stats.clopper_pearson("k", "n")).select("role", "n", "k", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(
    "priority_pick",
    "WITH p AS (SELECT doc_id, n_chars, source, CASE WHEN text LIKE '%License%' THEN 0 WHEN text LIKE '%@%' THEN 1 WHEN text LIKE '%|%' THEN 2 END AS pattern FROM documents) SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pattern NULLS LAST, n_chars NULLS LAST, doc_id) AS r FROM p) WHERE r <= 5",
)
def priority_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents of each source: those with the first required pattern before the others, smaller ones first."""
    t = F.col("text")
    pattern = F.when(t.like("%License%"), 0).when(t.like("%@%"), 1).when(t.like("%|%"), 2)
    rows = table(spark, sf, "documents").select("source", "doc_id", "n_chars", pattern.alias("p"))
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("p"), F.asc_nulls_last("n_chars"), "doc_id"))
    return rows.withColumn("r", first).filter("r <= 5").select("source", "doc_id")


@query(
    "claim_number_guard",
    r"""WITH c AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(a.text, '[0-9]+(?:[.,][0-9]+)*')) AS x, list_distinct(regexp_extract_all(b.text, '[0-9]+(?:[.,][0-9]+)*')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(x) AS n_numbers, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS n_strange FROM c""",
)
def claim_number_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a claim (a turn) that its answer (the next turn) does not have."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(fx.numbers_strict(F.col("text"))).alias("x"))
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    n = lambda a: F.size(a).cast("long")
    return c.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", n(F.col("x")).alias("n_numbers"), n(F.array_except("x", "y")).alias("n_strange"))


@query(
    "changed_pairs_on_page",
    """WITH a AS (SELECT l_orderkey AS page, 'item' || l_partkey AS label, l_quantity::BIGINT AS v, l_linenumber AS y FROM lineitem), b AS (SELECT page, label, v + CASE WHEN page % 9 = 0 THEN 1 ELSE 0 END AS v FROM a), p AS (SELECT page, label || ' ' || v || '.' AS line FROM a WHERE y <= 4),
c AS (SELECT DISTINCT page, label, v FROM b EXCEPT SELECT page, label, v FROM a) SELECT c.page, c.label, c.v, count(line) > 0 AS on_page FROM c LEFT JOIN p ON p.page = c.page AND line = c.label || ' ' || c.v || '.' GROUP BY ALL""",
)
def changed_pairs_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """Label and number pairs of a new version that the old one lacks, each looked up in its page's lines under the number guard."""
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat(F.lit("item"), F.col("l_partkey").cast("string")).alias("label"), F.col("l_quantity").cast("long").alias("v"), "l_linenumber")
    lines = a.filter("l_linenumber <= 4").select("page", F.concat("label", F.lit(" "), F.col("v").cast("string"), F.lit(".")).alias("line"))
    b = a.select("page", "label", (F.col("v") + F.when(F.col("page") % 9 == 0, 1).otherwise(0)).alias("v"))
    return records.changed_pairs(a.select("page", "label", "v"), b, lines, "page", "label", "v", "line")


@query(
    "collection_scroll",
    "WITH v AS (SELECT vec_id, label, 0 AS n FROM embeddings UNION ALL SELECT vec_id + 7, label + 100, 1 FROM embeddings WHERE vec_id % 3 = 0), l AS (SELECT vec_id, arg_max(label, n) AS label FROM v GROUP BY vec_id) SELECT vec_id, label, (SELECT count(*) FROM l) AS size FROM l WHERE vec_id > 20 ORDER BY vec_id LIMIT 50",
)
def collection_scroll(spark: SparkSession, sf: str) -> DataFrame:
    """A collection after an upsert, where the later row of an id wins; its size, and the page of 50 points behind id 20."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0).alias("n"))
    new = e.filter("vec_id % 3 = 0").select((F.col("vec_id") + 7).alias("vec_id"), (F.col("label") + 100).alias("label"), F.lit(1).alias("n"))
    points = records.upserted(e, new, "vec_id", "n", ["label"])
    size = points.agg(F.count("*").alias("size"))
    return points.filter("vec_id > 20").orderBy("vec_id").limit(50).join(F.broadcast(size)).select("vec_id", "label", "size")


@query(
    "flags_with_numbers",
    "SELECT unit, line_no, CASE WHEN gap <= 3 THEN 'R ' || q END AS merged, CASE WHEN gap <= 3 THEN 1 ELSE 2 END::BIGINT AS n_tokens FROM (SELECT l_orderkey AS unit, l_linenumber AS line_no, l_partkey AS part, CAST(l_quantity::BIGINT AS VARCHAR) AS q, l_suppkey % 7 AS gap FROM lineitem)",
)
def flags_with_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A revision mark and a number on a line, one token where at most three points lie between them."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").cast("long").cast("string").alias("q"), (F.col("l_suppkey") % 7).alias("gap"))
    both = F.array(F.struct(F.lit("R").alias("text"), F.lit(0).cast("long").alias("x0"), F.lit(10).cast("long").alias("x1")), F.struct(F.col("q").alias("text"), (F.col("gap") + 10).alias("x0"), (F.col("gap") + 40).alias("x1")))
    merged = records.merged_flags(both, 3)
    return li.select("unit", "line_no", F.try_element_at(F.filter(merged, lambda x: F.startswith(x, F.lit("R "))), F.lit(1)).alias("merged"), F.size(merged).cast("long").alias("n_tokens"))
