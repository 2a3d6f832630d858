"""Pages, grids and nested objects set from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from .registry import query, table

LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"


@query(
    "page_classes",
    r"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN w <= 14 AND doc_id % 3 = 0 THEN 'image-only' WHEN starts_with(text, 'Figure') OR doc_id % 17 = 0 THEN 'figure' WHEN contains(text, 'icense') THEN 'notes' WHEN contains(text, '|') THEN 'headed table' WHEN w <= 12 THEN 'divider' ELSE 'text' END AS class
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM documents)) GROUP BY class""",
)
def page_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages: a third has images, some begin with a figure's caption, license lines are notes, rows with pipes are tables."""
    t = F.col("text")
    words = F.size(F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    named = F.filter(F.array(F.when(F.contains(t, F.lit("icense")), "note"), F.when(F.contains(t, F.lit("|")), "table")), lambda x: x.isNotNull())
    first = F.when(F.col("doc_id") % 17 == 0, "Figure 1").otherwise(t)
    kind = pages.page_class(words, F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0), first, named)
    return table(spark, sf, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


HEAD_SQL = r"""WITH l AS (SELECT l_suppkey AS unit, l_orderkey AS page, l_linenumber AS y, 'Table ' || (l_partkey % 4) || '.' || l_linenumber || ' of' AS line FROM lineitem), t AS (SELECT * FROM l WHERE y < 10 / 4.0 AND regexp_matches(line, '^Table [13]\.')),
h AS (SELECT unit, page, arg_min(line, (y, line)) AS heading FROM t GROUP BY ALL), i AS (SELECT *, regexp_extract(heading, '^Table ([13])\.', 1) AS id FROM h), f AS (SELECT unit, coalesce(max(CASE WHEN id = '1' THEN page END), 0) AS first FROM i GROUP BY unit)"""


@query("heading_block", HEAD_SQL + " SELECT unit, page, id, heading FROM i JOIN f USING (unit) WHERE page >= first")
def heading_block(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    line = F.concat(F.lit("Table "), (F.col("l_partkey") % 4).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(" of"))
    lines = li.select(F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("y"), line.alias("line"))
    return pages.block_from_last(pages.page_headings(lines, "unit", "page", "y", "line", F.lit(10), r"^Table ([13])\."), "unit", "page", "1")


@query(
    "trigger_counts",
    """WITH s AS (SELECT l_orderkey AS unit, l_linenumber AS line_no, CAST(l_quantity::BIGINT AS VARCHAR) AS q, l_partkey FROM lineitem), v AS (SELECT unit, line_no, q, 100 + (l_partkey % 3) * 200 AS x1, length(q) * 10 AS w FROM s),
b AS (SELECT unit, count(DISTINCT line_no) AS numeric_lines, count(DISTINCT x1) AS bands FROM v GROUP BY unit), g AS (SELECT unit, count(DISTINCT line_no) AS grid_rows, count(DISTINCT 1 + l_partkey % 2) AS grid_cols FROM s GROUP BY unit)
SELECT unit, numeric_lines, bands, grid_rows, grid_cols, numeric_lines <> grid_rows OR bands <> grid_cols AS fired FROM b JOIN g USING (unit)""",
)
def trigger_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities printed in three places across, parsed into two columns."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").cast("long").cast("string").alias("text"), "l_partkey")
    x1 = 100.0 + (F.col("l_partkey") % 3) * 200
    tokens = li.select("unit", "line_no", F.lit(1).alias("pos"), "text", (x1 - F.length("text") * 10).alias("x0"), x1.alias("x1"))
    grid = li.select("unit", F.col("line_no").alias("row_no"), (1 + F.col("l_partkey") % 2).alias("col_no"), "text", F.lit(False).alias("header"))
    return pages.trigger_counts(tokens, grid, ["unit"])


CAUSE_SQL = """WITH t AS (SELECT l_suppkey AS unit, l_orderkey AS cell, l_partkey % 5 AS col_no, l_linenumber % 2 AS row_no, l_partkey % 7 AS band, l_linenumber AS line_no FROM lineitem),
bc AS (SELECT unit, band, arg_max(col_no, (n, -col_no)) AS c FROM (SELECT unit, band, col_no, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL), lr AS (SELECT unit, line_no, arg_max(row_no, (n, -row_no)) AS r FROM (SELECT unit, line_no, row_no, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
c AS (SELECT unit, cell, count(*) AS n, count(DISTINCT band) AS b, count(DISTINCT c) AS bc, count(DISTINCT line_no) AS l, count(DISTINCT r) AS lr FROM t JOIN bc USING (unit, band) JOIN lr USING (unit, line_no) GROUP BY ALL)
SELECT unit, CASE WHEN b > 1 THEN CASE WHEN bc = 1 THEN 'column collapse' ELSE 'column straddle' END WHEN l > 1 THEN CASE WHEN lr = 1 THEN 'row collapse' ELSE 'row straddle' END ELSE 'split token' END AS cause, count(*) AS n FROM c WHERE n > 1 GROUP BY ALL"""


@query("merge_causes", CAUSE_SQL)
def merge_causes(spark: SparkSession, sf: str) -> DataFrame:
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    tokens = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("cell"), (p % 5).alias("col_no"), (n % 2).alias("row_no"), (p % 7).alias("band"), n.alias("line_no"))
    return pages.merge_causes(tokens, ["unit"])


@query("stitched_columns")
def stitched_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of orders: centres of the first lines against those of the later ones, some of them shifted by more than half a pitch."""
    li = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("unit"), F.col("l_linenumber").cast("long").alias("col_no")).agg(F.min("l_partkey").alias("k"))
    upper = li.filter("col_no <= 4").select("unit", "col_no", (F.col("col_no") * 100.0).alias("x"))
    lower = li.select("unit", "col_no", (F.col("col_no") * 100.0 + (F.col("k") % 4) * 20.0).alias("x"))
    return pages.stitched_columns(upper, lower, ["unit"])


DIFF_SQL = """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS y, l_quantity::BIGINT AS q, l_returnflag AS f, l_partkey AS p FROM lineitem), b AS (SELECT k, y, q + CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END AS q, CASE WHEN p % 14 = 0 THEN 'X' ELSE f END AS f, p FROM a WHERE NOT (k % 11 = 0 AND y = 1)),
o AS (SELECT k, max(y) AS r, count(*) AS n FROM a GROUP BY k), u AS (SELECT k, max(y) AS r, count(*) AS n FROM b GROUP BY k),
ca AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y, p, f, q) - 1 AS i FROM a), cb AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y, p, f, q) - 1 AS i FROM b),
d AS (SELECT ca.k, min(i) AS i, arg_min(concat_ws(',', CASE WHEN ca.f <> cb.f THEN 'f' END, CASE WHEN ca.q <> cb.q THEN 'q' END, CASE WHEN ca.y <> cb.y THEN 'y' END), i) AS names FROM ca JOIN cb USING (k, i) WHERE ca.q <> cb.q OR ca.f <> cb.f OR ca.y <> cb.y GROUP BY ca.k)
SELECT o.k, CASE WHEN o.r <> u.r THEN 'shape ' || o.r || 'x3 -> ' || u.r || 'x3' WHEN o.n <> u.n THEN 'cells ' || o.n || ' -> ' || u.n WHEN d.k IS NOT NULL THEN 'cell ' || d.i || ': ' || d.names END AS difference FROM o JOIN u USING (k) LEFT JOIN d USING (k)"""


@query("first_differences", DIFF_SQL)
def first_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against a version with some quantities and flags changed and some first lines gone."""
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("long").alias("q"))
    flag, more = F.when(F.col("p") % 14 == 0, "X").otherwise(F.col("f")), F.col("q") + F.when(F.col("p") % 7 == 0, 1).otherwise(0)
    b = a.filter("not (k % 11 = 0 and y = 1)").select("k", "y", "p", flag.alias("f"), more.alias("q"))
    whole = lambda d, n: d.groupBy("k").agg(F.max("y").alias(f"r{n}"), F.array_sort(F.collect_list(F.struct("y", "p", "f", "q"))).alias(f"c{n}"))
    both = whole(a, 1).join(whole(b, 2), "k")
    three = F.lit(3)
    return both.select("k", pages.first_difference([F.col("r1"), three], [F.col("r2"), three], F.col("c1"), F.col("c2"), ["q", "f", "y"]).alias("difference"))


KEPT_SQL = r"""WITH x AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, '|' || l_partkey || '�' || l_quantity::BIGINT || '| �' || l_returnflag || '|' AS row, l_partkey % 3 = 0 AS loose FROM lineitem)
SELECT k, CASE WHEN k % 5 = 0 THEN 1 + 2 * count(*) + count(*) FILTER (loose) ELSE 1 END::BIGINT AS header, CASE WHEN k % 5 = 0 THEN 0 ELSE count(*) END AS in_number, CASE WHEN k % 5 = 0 THEN 0 ELSE count(*) + count(*) FILTER (loose) END AS other FROM x GROUP BY k"""


@query("kept_positions", KEPT_SQL)
def kept_positions(spark: SparkSession, sf: str) -> DataFrame:
    """A markdown table of each order, with marks in its header, in numbers, before flags and in loose lines; every fifth has no separator row."""
    q = F.col("l_quantity").cast("long").cast("string")
    row = F.concat(F.lit("|"), F.col("l_partkey").cast("string"), F.lit("�"), q, F.lit("| �"), F.col("l_returnflag"), F.lit("|"), F.when(F.col("l_partkey") % 3 == 0, "\nnote �").otherwise(""))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", row.alias("row"))
    body = li.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))), lambda x: x["row"]), "\n").alias("body"))
    text = F.concat(F.lit("|item �|flag|\n"), F.when(F.col("k") % 5 != 0, "|---|---|\n").otherwise(""), F.col("body"))
    return body.withColumn("p", pages.kept_positions(text)).select("k", "p.header", "p.in_number", "p.other")


@query(
    "grown_bands",
    """WITH RECURSIVE c AS (SELECT DISTINCT l_orderkey % 200 AS unit, l_orderkey AS cell, l_partkey % 1000 AS band FROM lineitem), f AS (SELECT DISTINCT unit, band FROM c WHERE band % 50 = 0
UNION SELECT x.unit, y.band FROM f JOIN c x ON x.unit = f.unit AND x.band = f.band JOIN c y ON y.unit = x.unit AND y.cell = x.cell) SELECT unit, count(*) AS n_failing, min(band) AS least FROM f GROUP BY unit""",
)
def grown_bands(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("unit"), F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 1000).alias("band"))
    grown = pages.grown_bands(cells, cells.filter("band % 50 = 0"), ["unit"], "cell", "band")
    return grown.groupBy("unit").agg(F.count("*").alias("n_failing"), F.min("band").alias("least"))


@query("best_columns", "SELECT l_orderkey // 20 AS unit, '0,2' AS columns, 2 * count(DISTINCT l_orderkey * 10 + l_linenumber) AS admitted FROM lineitem GROUP BY 1")
def best_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Printed tables of twenty orders with one column too many before the quantity against the served ones."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min(F.col("l_quantity").cast("long")).alias("q"))
    unit, row = F.floor(F.col("l_orderkey") / 20).alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no")
    cell = lambda k, c: li.select(unit, row, F.lit(k).cast("long").alias("col_no"), c.cast("string").alias("text"))
    p, q = F.col("p"), F.col("q")
    printed = cell(0, p).unionByName(cell(1, F.lit("..."))).unionByName(cell(2, q))
    return pages.best_columns(printed, cell(0, p).unionByName(cell(1, q)), ["unit"]).withColumn("columns", F.array_join(F.col("columns").cast("array<string>"), ","))


@query(
    "token_batches",
    """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) - 1 AS r FROM conversations WHERE text IS NOT NULL), b AS (SELECT 0::BIGINT AS batch, 0::BIGINT AS s, greatest(1, 4000 // greatest(n, 1))::BIGINT AS per FROM r WHERE r = 0
UNION ALL SELECT batch + 1, s + per, greatest(1, 4000 // greatest(r.n, 1))::BIGINT FROM b JOIN r ON r.r = b.s + b.per) SELECT batch, count(*) AS n, max(r.n) AS width FROM b JOIN r ON r.r >= s AND r.r < s + per GROUP BY batch""",
)
def token_batches(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").filter("text is not null").select(F.struct("conv_id", "turn").alias("key"), F.length("text").alias("n"))
    return pages.token_batches(c, "key", "n", 4000).groupBy("batch").agg(F.count("*").alias("n"), F.max("n").alias("width"))
