"""Agreement statistics and decision rules over labels (two raters: quality and toxic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decision, stats
from .registry import query, table

BASE = "(SELECT l.doc_id, quality, toxic, 1 - quality AS bad, source, lang, n_chars FROM labels l JOIN documents d USING (doc_id))"


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").withColumn("bad", 1 - F.col("quality"))


KAPPA_SQL = """WITH c AS (SELECT {g} bad, toxic, count(*)::DOUBLE AS n FROM {b} GROUP BY ALL), a AS (SELECT {g} bad AS v, sum(n) AS x FROM c GROUP BY ALL), t AS (SELECT {g} toxic AS v, sum(n) AS y FROM c GROUP BY ALL),
e AS (SELECT {g} sum(x * y) AS e FROM a JOIN t USING ({u} v) GROUP BY ALL), s AS (SELECT {g} sum(n) AS n, sum(CASE WHEN bad = toxic THEN n ELSE 0 END) AS o FROM c GROUP BY ALL)
SELECT {g} n::BIGINT AS n, o::BIGINT AS agreed, round((n * o - coalesce(e, 0)) / nullif(n * n - coalesce(e, 0), 0), 6) AS kappa FROM s {j}"""


@query("cohen_kappa_exact", KAPPA_SQL.format(g="", u="", b=BASE, j=", e"))
def cohen_kappa_exact(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kappa(_rated(spark, sf), [], "bad", "toxic").withColumn("kappa", F.round("kappa", 6))


@query("kappa_by_group", KAPPA_SQL.format(g="lang,", u="lang,", b=BASE, j="LEFT JOIN e USING (lang)"))
def kappa_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kappa(_rated(spark, sf), ["lang"], "bad", "toxic").withColumn("kappa", F.round("kappa", 6))


@query(
    "auroc_ranks",
    f"""WITH p AS (SELECT a.lang, sum(CASE WHEN a.n_chars > b.n_chars THEN 2 WHEN a.n_chars = b.n_chars THEN 1 ELSE 0 END) AS w, count(*) AS n FROM {BASE} a JOIN {BASE} b ON a.lang = b.lang AND a.toxic = 1 AND b.toxic = 0 GROUP BY a.lang)
SELECT l.lang, round(w / (2.0 * n), 6) AS auroc FROM (SELECT DISTINCT lang FROM {BASE}) l LEFT JOIN p USING (lang)""",
)
def auroc_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.auroc(_rated(spark, sf), ["lang"], "n_chars", "toxic").withColumn("auroc", F.round("auroc", 6))


@query(
    "wilson_intervals",
    f"""WITH c AS (SELECT source, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS k FROM {BASE} GROUP BY source), p AS (SELECT *, k / n AS p, 1.96 AS z FROM c),
h AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM p)
SELECT source, n::BIGINT AS n, k::BIGINT AS k, round(greatest(0, m - h), 6) AS low, round(least(1, m + h), 6) AS high FROM h""",
)
def wilson_intervals(spark: SparkSession, sf: str) -> DataFrame:
    c = _rated(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    w = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return c.withColumn("w", w).select("source", "n", "k", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


#: Clopper-Pearson by 60 steps of bisection; {k}: hits, {key}: the group.
EXACT_SQL = """WITH RECURSIVE c AS ({counts}), b AS (SELECT *, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1, 0 AS step FROM c
UNION ALL SELECT key, n, k, CASE WHEN t < 0.025 THEN l ELSE l0 END, CASE WHEN t < 0.025 THEN l1 ELSE l END, CASE WHEN u < 0.975 THEN h ELSE h0 END, CASE WHEN u < 0.975 THEN h1 ELSE h END, step + 1
FROM (SELECT *, (l0 + l1) / 2 AS l, (h0 + h1) / 2 AS h, coalesce(list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((l0 + l1) / 2) + (n - i) * ln(1 - (l0 + l1) / 2)) FOR i IN range(k, n + 1)]), 0) AS t,
coalesce(list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((h0 + h1) / 2) + (n - i) * ln(1 - (h0 + h1) / 2)) FOR i IN range(k + 1, n + 1)]), 0) AS u FROM b WHERE step < 60))
SELECT key AS {key}, n, k, round(CASE WHEN k = 0 THEN 0 ELSE (l0 + l1) / 2 END, 6) AS low, round(CASE WHEN k = n THEN 1 ELSE (h0 + h1) / 2 END, 6) AS high FROM b WHERE step = 60"""


@query("clopper_pearson", EXACT_SQL.format(key="source", counts=f"SELECT source AS key, count(*) AS n, sum(toxic)::BIGINT AS k FROM {BASE} GROUP BY source"))
def clopper_pearson(spark: SparkSession, sf: str) -> DataFrame:
    c = _rated(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    return c.withColumn("w", stats.clopper_pearson("k", "n")).select("source", "n", "k", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(
    "mcnemar",
    f"""WITH d AS (SELECT source, count(*) FILTER (bad = 1 AND toxic = 0) AS b, count(*) FILTER (bad = 0 AND toxic = 1) AS c FROM {BASE} GROUP BY source)
SELECT source, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) FOR i IN range(greatest(b, c), b + c + 1)])) END, 6) AS p FROM d""",
)
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    c = _rated(spark, sf).groupBy("source").agg(F.count_if(F.expr("bad = 1 and toxic = 0")).alias("b"), F.count_if(F.expr("bad = 0 and toxic = 1")).alias("c"))
    return c.withColumn("p", F.round(stats.mcnemar("b", "c"), 6))


#: Student's t by Cornish-Fisher expansion to the fourth order, good to 6 digits from 30 degrees of freedom on; z is the normal quantile.
PAIRED_SQL = f"""WITH r AS (SELECT lang, count(*) AS n, avg(bad - toxic) AS m, stddev_samp(bad - toxic) AS s FROM {BASE} GROUP BY ALL HAVING count(*) > 30),
q AS (SELECT *, n - 1 AS v, 1.959963984540054::DOUBLE AS z FROM r), t AS (SELECT *, z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * v**4) AS q FROM q)
SELECT lang, n, round(m, 6) AS mean, round(m - q * s / sqrt(n), 5) AS low, round(m + q * s / sqrt(n), 5) AS high FROM t"""


@query("paired_t", PAIRED_SQL)
def paired_t(spark: SparkSession, sf: str) -> DataFrame:
    """95 % intervals of the mean paired difference by language, for those with more than 30 rows."""
    d = F.col("bad") - F.col("toxic")
    part = _rated(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("s")).filter("n > 30")
    half = stats.t95(F.col("n") - 1) * F.col("s") / F.sqrt("n")
    return part.withColumn("half", half).select("lang", "n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - F.col("half"), 5).alias("low"), F.round(F.col("mean") + F.col("half"), 5).alias("high"))


BA_SQL = f"SELECT source, count(*) FILTER (bad = 1) AS k, count(*) FILTER (bad = 0) AS m, count(*) FILTER (bad = 1 AND toxic = 1) AS tp, count(*) FILTER (bad = 0 AND toxic = 0) AS tn FROM {BASE} GROUP BY source"


@query("balanced_accuracy", f"SELECT source, k, m, tp, tn, round((tp / nullif(k, 0) + tn / nullif(m, 0)) / 2, 6) AS ba, (m - tn) * 5 <= m AND (k < 4 OR tp >= 2) AS eligible FROM ({BA_SQL})")
def balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.balanced_accuracy(_rated(spark, sf), ["source"], "bad", "toxic").withColumn("ba", F.round("ba", 6))
    return out.withColumn("eligible", stats.eligible(*map(F.col, ("k", "m", "tp", "tn"))))


@query(
    "verifier_choice",
    f"""WITH t AS (SELECT 'long' AS name, count(*) FILTER (bad = 1) AS k, count(*) FILTER (bad = 0) AS m, count(*) FILTER (bad = 1 AND n_chars > 6000) AS tp, count(*) FILTER (bad = 0 AND n_chars <= 6000) AS tn FROM {BASE}
UNION ALL SELECT 'toxic', count(*) FILTER (bad = 1), count(*) FILTER (bad = 0), count(*) FILTER (bad = 1 AND toxic = 1), count(*) FILTER (bad = 0 AND toxic = 0) FROM {BASE}),
e AS (SELECT * FROM t WHERE (m - tn) * 5 <= m AND (k < 4 OR tp >= 2)), x AS (SELECT count(*) AS n_ok, arg_min(tp, name) AS atp, arg_min(tn, name) AS atn, arg_max(tp, name) AS btp, arg_max(tn, name) AS btn, min(name) AS a, max(name) AS b, max(k) AS k, max(m) AS m FROM e)
SELECT CASE WHEN n_ok = 0 THEN NULL WHEN n_ok = 1 THEN a WHEN k = 0 OR m = 0 OR abs(atp - btp) + abs(atn - btn) <= 1 OR atp * m + atn * k = btp * m + btn * k THEN 'long' WHEN atp * m + atn * k > btp * m + btn * k THEN a ELSE b END AS choice,
CASE WHEN n_ok = 0 THEN 'none eligible' WHEN n_ok = 1 THEN 'only one' WHEN k = 0 OR m = 0 THEN 'empty class' WHEN abs(atp - btp) + abs(atn - btn) <= 1 THEN 'one claim apart' WHEN atp * m + atn * k = btp * m + btn * k THEN 'tie' ELSE 'better' END AS rule, n_ok FROM x""",
)
def verifier_choice(spark: SparkSession, sf: str) -> DataFrame:
    rated = _rated(spark, sf).withColumn("long", (F.col("n_chars") > 6000).cast("int"))
    rows = rated.select("bad", F.explode(F.create_map(F.lit("long"), F.col("long"), F.lit("toxic"), F.col("toxic"))).alias("name", "flag"))
    return decision.choose_verifier(stats.balanced_accuracy(rows, ["name"], "bad", "flag").withColumn("scored", F.lit(True)), "long")


@query("readability_gate", f"SELECT source, count(*) FILTER (bad = 1) AS k, count(*) FILTER (bad = 0) AS m, count(*) FILTER (bad = 1) >= 8 AND count(*) FILTER (bad = 0) >= 8 AS readable FROM {BASE} GROUP BY source")
def readability_gate(spark: SparkSession, sf: str) -> DataFrame:
    out = _rated(spark, sf).groupBy("source").agg(F.count_if(F.expr("bad = 1")).alias("k"), F.count_if(F.expr("bad = 0")).alias("m"))
    return out.withColumn("readable", decision.readable(F.col("k"), F.col("m")))


@query(
    "multi_criterion_verdict",
    f"SELECT lang, count(*) FILTER (bad = 1) * 5 <= count(*) AS few_bad, count(*) FILTER (toxic = 1) * 4 <= count(*) AS few_toxic, avg(n_chars) >= 500 AS long_enough, CASE WHEN count(*) FILTER (bad = 1) * 5 <= count(*) AND count(*) FILTER (toxic = 1) * 4 <= count(*) AND avg(n_chars) >= 500 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {BASE} GROUP BY lang",
)
def multi_criterion_verdict(spark: SparkSession, sf: str) -> DataFrame:
    out = _rated(spark, sf).groupBy("lang").agg((F.count_if(F.expr("bad = 1")) * 5 <= F.count("*")).alias("few_bad"), (F.count_if(F.expr("toxic = 1")) * 4 <= F.count("*")).alias("few_toxic"), (F.avg("n_chars") >= 500).alias("long_enough"))
    return out.withColumn("verdict", F.when(F.col("few_bad") & F.col("few_toxic") & F.col("long_enough"), "PASS").otherwise("FAIL"))


DRAW = "floor(CAST(('0x' || substr(md5(b || ':' || j), 1, 8)) AS BIGINT) / 4294967296.0 * n_c)::BIGINT"
BOOT_SQL = """WITH c AS (SELECT {sums} source FROM {base} GROUP BY source), i AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS i FROM c), t AS (SELECT count(*) AS n_c FROM c), j AS (SELECT unnest(range(n_c)) AS j, n_c FROM t),
d AS (SELECT b, {draw} AS i FROM range({rounds}) r(b), j), s AS (SELECT b, {value} AS rate FROM d JOIN i USING (i) GROUP BY b)"""
RATE = {"sums": "count(*) AS n, sum(toxic) AS k,", "base": BASE, "draw": DRAW, "value": "sum(k)::DOUBLE / nullif(sum(n), 0)"}


def _rounds(spark: SparkSession, sf: str, rounds: int) -> DataFrame:
    clusters = _rated(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    return stats.cluster_resamples(clusters, "source", rounds, ["k", "n"]).withColumn("rate", F.try_divide(F.col("k"), F.col("n")))


@query("cluster_bootstrap_ci", BOOT_SQL.format(rounds=1000, **RATE) + " SELECT round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high, count(*) FILTER (rate IS NULL) AS undefined FROM s")
def cluster_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 resamples of all sources with replacement."""
    out = stats.percentile_interval(_rounds(spark, sf, 1000), [], "rate")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "undefined")


@query("table_bootstrap_ci", BOOT_SQL.format(rounds=10_000, **RATE) + ", v AS (SELECT list_sort(list(rate)) AS v FROM s WHERE rate IS NOT NULL) SELECT round(v[floor(0.025 * (len(v) - 1))::INT + 1], 6) AS low, round(v[floor(0.975 * (len(v) - 1))::INT + 1], 6) AS high FROM v")
def table_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """10,000 resamples, order statistics."""
    out = stats.order_interval(_rounds(spark, sf, 10_000).filter("rate is not null"), [], "rate")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


TWO = "count(*) FILTER (bad = 1 AND toxic = 1)::DOUBLE AS a, count(*) FILTER (bad = 1 AND toxic = 0)::DOUBLE AS b_, count(*) FILTER (bad = 0 AND toxic = 1)::DOUBLE AS c_, count(*) FILTER (bad = 0 AND toxic = 0)::DOUBLE AS d_,"
KAPPA_RATE = "2 * (sum(a) * sum(d_) - sum(b_) * sum(c_)) / nullif((sum(a) + sum(b_)) * (sum(b_) + sum(d_)) + (sum(a) + sum(c_)) * (sum(c_) + sum(d_)), 0)"


@query(
    "kappa_bootstrap_ci",
    BOOT_SQL.format(rounds=1000, sums=TWO, base=BASE, draw=DRAW, value=KAPPA_RATE) + " SELECT round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high, count(*) FILTER (rate IS NULL) AS undefined FROM s",
)
def kappa_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Kappa under 1,000 resamples of sources: a table of counts per source is all that is drawn."""
    n = lambda x, y: F.count_if((F.col("bad") == x) & (F.col("toxic") == y)).cast("double")
    clusters = _rated(spark, sf).groupBy("source").agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    rows = stats.cluster_resamples(clusters, "source", 1000, ["a", "b", "c", "d"]).withColumn("kappa", stats.kappa_of_counts(*map(F.col, "abcd")))
    return stats.percentile_interval(rows, [], "kappa").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "undefined")


THREE = "CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED' WHEN quality = 1 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END"
FOLDS = {"3-class": THREE, "binary": f"CASE WHEN {THREE} = 'PARTIAL' THEN 'UNSUPPORTED' ELSE {THREE} END", "reverse": f"CASE WHEN {THREE} = 'PARTIAL' THEN 'SUPPORTED' ELSE {THREE} END"}
CELL_SQL = " UNION ALL ".join(
    "SELECT * FROM (" + KAPPA_SQL.format(g="fold,", u="fold,", j="LEFT JOIN e USING (fold)", b=f"(SELECT '{name}' AS fold, {truth} AS bad, CASE WHEN n_chars > 2000 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS toxic FROM {BASE})") + ")"
    for name, truth in FOLDS.items()
)


@query("cell_kappas", CELL_SQL)
def cell_kappas(spark: SparkSession, sf: str) -> DataFrame:
    """Kappa of one verdict with three classes, with PARTIAL as UNSUPPORTED, and with PARTIAL as SUPPORTED."""
    three = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTED").when(F.col("quality") == 1, "PARTIAL").otherwise("UNSUPPORTED")
    rows = _rated(spark, sf).select(three.alias("three"), F.when(F.col("n_chars") > 2000, "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"))
    to = lambda x: F.when(F.col("three") == "PARTIAL", x).otherwise(F.col("three"))
    folds = F.create_map(F.lit("3-class"), F.col("three"), F.lit("binary"), to("UNSUPPORTED"), F.lit("reverse"), to("SUPPORTED"))
    rows = rows.select(F.explode(folds).alias("fold", "truth"), "verdict")
    return stats.kappa(rows, ["fold"], "truth", "verdict").withColumn("kappa", F.round("kappa", 6))


@query(
    "align_refusals",
    f"""WITH a AS (SELECT lang, doc_id FROM {BASE}), b AS (SELECT lang, doc_id, CASE WHEN lang = 'de' AND doc_id % 20 = 0 THEN 'FAIL' ELSE 'ok' END AS status FROM {BASE} WHERE NOT (lang = 'fr' AND doc_id % 3 = 0) UNION ALL SELECT 'en', -1, 'ok'), x AS (SELECT lang, count(*) AS n_labels FROM a GROUP BY lang), y AS (SELECT lang, count(*) AS n_scores, count(*) FILTER (status = 'FAIL') AS n_fail FROM b GROUP BY lang),
o AS (SELECT coalesce(a.lang, b.lang) AS lang, count(*) FILTER (a.lang IS NULL OR b.lang IS NULL) AS n_odd, count(*) AS n_ids FROM (SELECT DISTINCT * FROM a) a FULL JOIN (SELECT DISTINCT lang, doc_id FROM b) b ON a.lang = b.lang AND a.doc_id = b.doc_id GROUP BY 1)
SELECT lang, coalesce(n_labels, 0) AS n_labels, coalesce(n_scores, 0) AS n_scores, coalesce(n_fail, 0) AS n_fail, n_odd, CASE WHEN n_fail > 0 THEN 'FAIL rows' WHEN coalesce(n_labels, 0) <> coalesce(n_scores, 0) THEN 'row count' WHEN n_odd > 0 OR n_ids <> n_scores THEN 'ids' END AS refused FROM o LEFT JOIN x USING (lang) LEFT JOIN y USING (lang)""",
)
def align_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against scores with FAIL rows, gaps and a stray id planted by language."""
    labels = _rated(spark, sf).select("lang", "doc_id")
    status = F.when((F.col("lang") == "de") & (F.col("doc_id") % 20 == 0), "FAIL").otherwise("ok")
    scores = labels.filter("not (lang = 'fr' and doc_id % 3 = 0)").withColumn("status", status)
    stray = spark.createDataFrame([("en", -1, "ok")], "lang string, doc_id long, status string")
    return stats.align_refusals(labels, scores.unionByName(stray), ["lang"], "doc_id", "status")


BRANCH_SQL = f"""WITH c AS (SELECT source, count(*)::HUGEINT AS n, count(*) FILTER (bad = toxic)::HUGEINT AS o, count(*) FILTER (bad = 1)::HUGEINT AS x, count(*) FILTER (toxic = 1)::HUGEINT AS y FROM {BASE} GROUP BY source), k AS (SELECT source, n * o - (x * y + (n - x) * (n - y)) AS p, n * n - (x * y + (n - x) * (n - y)) AS q FROM c),
b AS (SELECT * FROM k WHERE q > 0 AND NOT EXISTS (SELECT 1 FROM k AS o WHERE o.q > 0 AND o.p * k.q > k.p * o.q))
SELECT round(max(p::DOUBLE / q), 6) AS kappa, count(*) AS n_best, CASE WHEN count(*) = 1 THEN min(source) END AS verifier, CASE WHEN count(*) > 1 THEN 'STOP' WHEN max(p::DOUBLE / q) >= 0.6 THEN 'GO' WHEN max(p::DOUBLE / q) >= 0.5 THEN 'GO, TUNE' ELSE 'NO-GO CANDIDATE' END AS branch FROM b"""


@query("kappa_branch", BRANCH_SQL)
def kappa_branch(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as verifiers: the best kappa as a fraction of whole numbers, and what it leads to."""
    is_ = lambda c: F.count_if(F.col(c) == 1)
    c = _rated(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("bad") == F.col("toxic")).alias("o"), is_("bad").alias("x"), is_("toxic").alias("y"))
    chance = F.expr("x * y + (n - x) * (n - y)")
    rows = c.select(F.col("source").alias("verifier"), F.lit("concatenated").alias("mode"), (F.expr("n * o") - chance).alias("p"), (F.expr("n * n") - chance).alias("q"))
    return decision.branch(rows, "verifier", "mode", "p", "q")


@query("failure_taxonomy", f"SELECT code, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'too_short' WHEN bad = 1 AND toxic = 0 THEN 'missed' WHEN bad = 0 AND toxic = 1 THEN 'false_alarm' ELSE 'other' END AS code FROM {BASE} WHERE bad <> toxic) GROUP BY code")
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("n_chars") < 100, "too_short").when((F.col("bad") == 1) & (F.col("toxic") == 0), "missed").when((F.col("bad") == 0) & (F.col("toxic") == 1), "false_alarm").otherwise("other")
    return _rated(spark, sf).filter("bad <> toxic").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query("threshold_verdicts", f"SELECT doc_id, CASE WHEN n_chars / 4000.0 > 0.5 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict, CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED' WHEN quality = 1 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS three, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS folded FROM {BASE}")
def threshold_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    three = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTED").when(F.col("quality") == 1, "PARTIAL").otherwise("UNSUPPORTED")
    return _rated(spark, sf).select("doc_id", F.when(F.col("n_chars") / 4000.0 > 0.5, "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"), three.alias("three"), (three == "SUPPORTED").cast("int").alias("folded"))


@query("loop_metrics", f"SELECT lang, round(sum(bad)::DOUBLE / count(*), 6) AS unsupported_rate, round(avg(CASE WHEN bad = 0 THEN n_chars END) / avg(n_chars), 6) AS retained, round(sum(CASE WHEN toxic = 0 AND bad = 0 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN bad = 0 THEN 1 ELSE 0 END), 0), 6) AS citation_accuracy FROM {BASE} GROUP BY lang")
def loop_metrics(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("bad") == 0
    return _rated(spark, sf).groupBy("lang").agg(
        F.round(F.sum("bad") / F.count("*"), 6).alias("unsupported_rate"),
        F.round(F.avg(F.when(good, F.col("n_chars"))) / F.avg("n_chars"), 6).alias("retained"),
        F.round(F.try_divide(F.count_if(good & (F.col("toxic") == 0)), F.count_if(good)), 6).alias("citation_accuracy"),
    )
