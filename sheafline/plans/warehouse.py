"""Relational coverage over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import integrity, joins
from .registry import query, table


def _dec(c: str, scale: int = 2):
    return F.col(c).cast(f"decimal(18,{scale})")


@query(
    "relational_division_unique",
    """WITH c AS (SELECT l_orderkey, l_partkey % 100 AS grp, l_linenumber || ':' || l_suppkey || ':' || l_quantity::BIGINT AS cell FROM lineitem), n AS (SELECT DISTINCT l_orderkey, cell FROM c), o AS (SELECT DISTINCT grp, cell FROM c), h AS (SELECT l_orderkey, grp, count(*) AS have FROM n JOIN o USING (cell) GROUP BY ALL), t AS (SELECT l_orderkey, count(*) AS need FROM n GROUP BY 1)
SELECT l_orderkey, grp, count(*) OVER (PARTITION BY l_orderkey) AS n_candidates FROM h JOIN t USING (l_orderkey) WHERE have = need""",
)
def relational_division_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that hold every cell (line, supplier, quantity) of an order."""
    cell = F.concat_ws(":", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long"))
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).alias("grp"), cell.alias("cell"))
    return joins.divide(li, li, "l_orderkey", "grp", "cell")


@query(
    "quarterly_annual_full_outer",
    """WITH q AS (SELECT year(o_orderdate) || '0' || quarter(o_orderdate) AS period, o_orderpriority AS series, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL), a AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, o_orderpriority AS series, count(*) AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT coalesce(q.series, a.series) AS series, coalesce(q.period, a.period) AS period, v, w FROM q FULL JOIN a ON q.series = a.series AND q.period = a.period""",
)
def quarterly_annual_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    year = F.year("o_orderdate").cast("string")
    q = o.filter("o_orderstatus = 'O'").groupBy(F.concat(year, F.lit("0"), F.quarter("o_orderdate").cast("string")).alias("period"), F.col("o_orderpriority").alias("series")).agg(F.count("*").alias("v"))
    a = o.filter("o_orderstatus = 'F'").groupBy(year.alias("period"), F.col("o_orderpriority").alias("series")).agg(F.count("*").alias("w"))
    return q.join(a, ["series", "period"], "full")


@query(
    "flips_baseline_candidate",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (x AND NOT y) AS flips, count(*) FILTER (NOT x AND y) AS gains, round(count(*) FILTER (x AND NOT y) / count(*), 6) AS rate FROM (SELECT l_returnflag, round(l_extendedprice, 1) = round(l_extendedprice::DECIMAL(18,2)::DOUBLE, 1) AND l_quantity > 5 AS x, floor(l_extendedprice * 10) / 10 = round(l_extendedprice, 1) AS y FROM lineitem) GROUP BY l_returnflag""",
)
def flips_baseline_candidate(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_extendedprice")
    x = (F.round(p, 1) == F.round(_dec("l_extendedprice").cast("double"), 1)) & (F.col("l_quantity") > 5)
    y = F.floor(p * 10) / 10 == F.round(p, 1)
    rows = table(spark, sf, "lineitem").select("l_returnflag", x.alias("x"), y.alias("y"))
    flips = F.count_if(F.col("x") & ~F.col("y"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), flips.alias("flips"), F.count_if(~F.col("x") & F.col("y")).alias("gains"), F.round(flips / F.count("*"), 6).alias("rate"))


@query(
    "two_way_diff",
    """WITH a AS (SELECT c_nationkey, c_mktsegment FROM customer), b AS (SELECT c_nationkey, CASE WHEN c_custkey % 13 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT c_nationkey, c_mktsegment, 'only_a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT c_nationkey, c_mktsegment, 'only_b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def two_way_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    other = F.when(F.col("c_custkey") % 13 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    return integrity.two_way_diff(c.select("c_nationkey", "c_mktsegment"), c.select("c_nationkey", other))


@query("set_intersection", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query(
    "field_level_diff",
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN c_name || '.' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 19 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT a.c_custkey, concat_ws(',', CASE WHEN a.c_name IS DISTINCT FROM b.c_name THEN 'c_name' END, CASE WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN 'c_acctbal' END, CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END) AS changed FROM customer a JOIN b USING (c_custkey) WHERE changed <> ''""",
)
def field_level_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer")
    k = F.col("c_custkey")
    b = a.withColumns({"c_name": F.when(k % 17 == 0, F.concat("c_name", F.lit("."))).otherwise(F.col("c_name")), "c_acctbal": F.when(k % 19 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(k % 23 != 0, F.col("c_mktsegment"))})
    return integrity.changed_fields(a, b, "c_custkey")


@query("adjacency_self_join", "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS next_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus")
def adjacency_self_join(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    a = table(spark, sf, "lineitem").select(*cols)
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_linenumber").alias("next_line"), "l_returnflag", "l_linestatus")
    return a.join(b, cols).select("l_orderkey", "l_linenumber", "next_line")


@query("quantiles_quartiles_caps", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(quantile_cont(l_quantity, 0.5), 6) AS q2, round(quantile_cont(l_quantity, 0.75), 6) AS q3, count(*) FILTER (l_quantity > 40) AS over_cap FROM lineitem GROUP BY 1")
def quantiles_quartiles_caps(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda p, name: F.round(F.percentile("l_quantity", F.lit(p)), 6).alias(name)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(q(0.25, "q1"), q(0.5, "q2"), q(0.75, "q3"), F.count_if(F.col("l_quantity") > 40).alias("over_cap"))


@query(
    "census_buckets",
    "SELECT l_returnflag, bucket, count(*) AS n, sum(m)::BIGINT AS merged, round(sum(m) / count(*), 6) AS rate FROM (SELECT l_returnflag, CASE WHEN l_quantity <= 10 THEN 's' WHEN l_quantity <= 30 THEN 'm' ELSE 'l' END AS bucket, CASE WHEN l_discount = l_tax THEN 1 ELSE 0 END AS m FROM lineitem) GROUP BY GROUPING SETS ((), (l_returnflag), (bucket), (l_returnflag, bucket))",
)
def census_buckets(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("l_quantity") <= 10, "s").when(F.col("l_quantity") <= 30, "m").otherwise("l")
    rows = table(spark, sf, "lineitem").select("l_returnflag", bucket.alias("bucket"), (F.col("l_discount") == F.col("l_tax")).cast("long").alias("m"))
    return rows.cube("l_returnflag", "bucket").agg(F.count("*").alias("n"), F.sum("m").alias("merged"), F.round(F.sum("m") / F.count("*"), 6).alias("rate"))


@query("census_worst15", "SELECT l_suppkey, count(*) AS n, sum(CASE WHEN l_discount = l_tax THEN 1 ELSE 0 END)::BIGINT AS merged FROM lineitem GROUP BY 1 ORDER BY merged DESC, l_suppkey LIMIT 15")
def census_worst15(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") == F.col("l_tax")).alias("merged"))
    return out.orderBy(F.desc("merged"), "l_suppkey").limit(15)


@query("share_max_guard", "WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, n, round(n / sum(n) OVER (), 6) AS share, 3 * n <= sum(n) OVER () AS within_third FROM s")
def share_max_guard(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row per group
    return s.select("o_orderpriority", "n", F.round(F.col("n") / total, 6).alias("share"), (3 * F.col("n") <= total).alias("within_third"))


@query("modal_decimals", "WITH d AS (SELECT l_suppkey, length(rtrim(split_part(CAST(l_discount::DECIMAL(18,4) AS VARCHAR), '.', 2), '0'))::BIGINT AS dec, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_max(dec, (n, -dec)) AS dec FROM d GROUP BY 1")
def modal_decimals(spark: SparkSession, sf: str) -> DataFrame:
    dec = F.length(F.rtrim(F.split_part(_dec("l_discount", 4).cast("string"), F.lit("."), F.lit(2)), F.lit("0"))).cast("long")
    votes = table(spark, sf, "lineitem").groupBy("l_suppkey", dec.alias("dec")).agg(F.count("*").alias("n"))
    return votes.groupBy("l_suppkey").agg(F.max_by("dec", F.struct("n", -F.col("dec"))).alias("dec"))


@query("half_up_render", "SELECT l_orderkey, l_linenumber, CAST(round(l_tax::DECIMAL(18,2), 1) AS VARCHAR) AS shown FROM lineitem")
def half_up_render(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(_dec("l_tax"), 1).cast("decimal(18,1)").cast("string").alias("shown"))


@query(
    "cost_usd",
    "SELECT l_returnflag, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(CAST(sum(i) * 1 + sum(o) * 5 AS DOUBLE) / 1000000, 6) AS batch_usd, round(CAST(sum(i) * 2 + sum(o) * 10 AS DOUBLE) / 1000000, 6) AS sync_usd FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) * 100 AS i, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS o FROM lineitem) GROUP BY 1",
)
def cost_usd(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf, "lineitem").select("l_returnflag", (q * 100).alias("i"), F.when(F.col("l_linenumber") % 5 == 0, 0).otherwise(q).alias("o"))
    i, o = F.sum("i"), F.sum("o")
    return rows.groupBy("l_returnflag").agg(i.alias("tokens_in"), o.alias("tokens_out"), F.round((i + o * 5) / 1_000_000, 6).alias("batch_usd"), F.round((i * 2 + o * 10) / 1_000_000, 6).alias("sync_usd"))


@query("cost_projection", "SELECT round(3740 * (avg(l_quantity) * 100 + avg(l_quantity) * 5) / 1000000, 6) AS usd, 3740 * (avg(l_quantity) * 100 + avg(l_quantity) * 5) / 1000000 <= 120 AS within_gate FROM lineitem")
def cost_projection(spark: SparkSession, sf: str) -> DataFrame:
    usd = 3740 * (F.avg("l_quantity") * 100 + F.avg("l_quantity") * 5) / 1_000_000
    return table(spark, sf, "lineitem").agg(F.round(usd, 6).alias("usd"), (usd <= 120).alias("within_gate"))


@query(
    "two_rule_subset",
    "SELECT l_suppkey, count(*) FILTER (l_discount >= 0.05) AS old_rule, count(*) FILTER (l_discount >= 0.05 OR l_tax >= 0.06) AS new_rule, count(*) FILTER (l_tax >= 0.06 AND l_discount < 0.05) AS delta FROM lineitem GROUP BY 1",
)
def two_rule_subset(spark: SparkSession, sf: str) -> DataFrame:
    old, new = F.col("l_discount") >= 0.05, (F.col("l_discount") >= 0.05) | (F.col("l_tax") >= 0.06)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(old).alias("old_rule"), F.count_if(new).alias("new_rule"), F.count_if(new & ~old).alias("delta"))


@query("recheck_rounding", "SELECT l_orderkey, l_linenumber, CAST(l_discount::DECIMAL(18,2) AS VARCHAR) AS printed FROM lineitem WHERE round(l_discount::DECIMAL(18,4), 1) <> l_discount::DECIMAL(18,2)")
def recheck_rounding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(F.round(_dec("l_discount", 4), 1) != _dec("l_discount")).select("l_orderkey", "l_linenumber", _dec("l_discount").cast("string").alias("printed"))


@query(
    "edition_check_unpivot",
    """WITH long AS (SELECT o_orderpriority AS series, month(o_orderdate) AS m, count(*) AS v FROM orders GROUP BY ALL), wide AS (SELECT o_orderpriority AS series, count(*) FILTER (month(o_orderdate) = 1) AS m1, count(*) FILTER (month(o_orderdate) = 2) AS m2, count(*) FILTER (month(o_orderdate) = 3 AND o_orderkey % 50 <> 0) AS m3 FROM orders GROUP BY 1),
u AS (SELECT series, 1 AS m, m1 AS w FROM wide UNION ALL SELECT series, 2, m2 FROM wide UNION ALL SELECT series, 3, m3 FROM wide)
SELECT count(*) FILTER (v = w) AS equal_n, count(*) FILTER (v <> w) AS unequal_n, count(*) FILTER (v IS NULL OR w IS NULL) AS single_n FROM (SELECT v, w FROM long FULL JOIN u ON long.series = u.series AND long.m = u.m)""",
)
def edition_check_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.month("o_orderdate").alias("m"), "o_orderkey")
    long = o.groupBy("series", "m").agg(F.count("*").alias("v"))
    wide = o.groupBy("series").agg(F.count_if(F.expr("m = 1")).alias("1"), F.count_if(F.expr("m = 2")).alias("2"), F.count_if(F.expr("m = 3 and o_orderkey % 50 <> 0")).alias("3"))
    tall = wide.unpivot("series", ["1", "2", "3"], "m", "w").withColumn("m", F.col("m").cast("int"))
    both = long.join(tall, ["series", "m"], "full")
    return both.agg(F.count_if(F.expr("v = w")).alias("equal_n"), F.count_if(F.expr("v <> w")).alias("unequal_n"), F.count_if(F.expr("v is null or w is null")).alias("single_n"))


@query(
    "ordered_classification",
    "SELECT class, count(*) AS n FROM (SELECT CASE WHEN l_quantity = a THEN 'same_as_line_before' WHEN l_quantity = b THEN 'same_as_line_after' WHEN l_discount = 0 THEN 'no_discount' WHEN l_tax > 0.05 THEN 'taxed' ELSE 'none' END AS class FROM (SELECT *, lag(l_quantity) OVER w AS a, lead(l_quantity) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))) GROUP BY 1",
)
def ordered_classification(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").withColumn("a", F.lag(q).over(w)).withColumn("b", F.lead(q).over(w))
    kind = F.when(q == F.col("a"), "same_as_line_before").when(q == F.col("b"), "same_as_line_after").when(F.col("l_discount") == 0, "no_discount").when(F.col("l_tax") > 0.05, "taxed").otherwise("none")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "header_miss_exists",
    "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'dropped' WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_brand = p.p_brand AND q.p_partkey <> p.p_partkey) THEN 'body' WHEN p_type = '' THEN 'empty' ELSE 'text' END AS cause FROM part p",
)
def header_miss_exists(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("p_name", "p_brand"))
    cause = F.when(F.col("p_size") > 45, "dropped").when(n > 1, "body").when(F.col("p_type") == "", "empty").otherwise("text")
    return table(spark, sf, "part").select("p_partkey", cause.alias("cause"))


@query("status_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return out.na.fill(0, ["F", "O", "P"])


@query(
    "mutation_shift_merge",
    """SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity = up) AS up_hits, count(*) FILTER (l_quantity = down) AS down_hits, count(DISTINCT (rn - 1) // 2) AS n_pairs FROM (SELECT *, lag(l_quantity) OVER w AS up, lead(l_quantity) OVER w AS down, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) GROUP BY 1""",
)
def mutation_shift_merge(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").withColumn("up", F.lag(q).over(w)).withColumn("down", F.lead(q).over(w)).withColumn("rn", F.row_number().over(w))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(q == F.col("up")).alias("up_hits"), F.count_if(q == F.col("down")).alias("down_hits"), F.countDistinct(F.floor((F.col("rn") - 1) / 2)).alias("n_pairs"))


@query("rollup_cube_distinct", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_cube_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("semi_anti_join", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    o = table(spark, sf, "orders").select("o_custkey")
    yes = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("has_orders", F.lit(True))
    return yes.unionByName(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("has_orders", F.lit(False)))


@query("star_join_revenue", "SELECT r_name, year(o_orderdate)::BIGINT AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY ALL")
def star_join_revenue(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are few
    return rows.groupBy("r_name", F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("theta_join", "SELECT n_nationkey, count(*) AS n FROM nation JOIN region ON n_regionkey > r_regionkey GROUP BY 1")
def theta_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") > F.col("r_regionkey")).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("policy_lookup", "SELECT s_suppkey, coalesce(n_name, 'none') AS policy FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def policy_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("policy"))


@query("ceiling_bound", "SELECT l_suppkey, greatest(0, count(*) - 2 * count(*) FILTER (l_discount = l_tax)) AS bound, round(greatest(0, count(*) - 2 * count(*) FILTER (l_discount = l_tax)) / count(*), 6) AS rate FROM lineitem GROUP BY 1")
def ceiling_bound(spark: SparkSession, sf: str) -> DataFrame:
    bound = F.greatest(F.lit(0), F.count("*") - 2 * F.count_if(F.col("l_discount") == F.col("l_tax")))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(bound.alias("bound"), F.round(bound / F.count("*"), 6).alias("rate"))


@query("tolerance_checks", "SELECT l_returnflag, abs(avg(l_discount) - 0.05) <= 0.001 AS discount_ok, abs(avg(l_tax) - 0.04) <= 0.001 AS tax_ok FROM lineitem GROUP BY 1")
def tolerance_checks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg((F.abs(F.avg("l_discount") - 0.05) <= 0.001).alias("discount_ok"), (F.abs(F.avg("l_tax") - 0.04) <= 0.001).alias("tax_ok"))
