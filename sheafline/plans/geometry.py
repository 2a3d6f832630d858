"""Order-dependent and interval queries, with event time as the axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, order
from .registry import query, table

EV = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS sec FROM events)"
ORDER = ("sec", "event_id")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.floor(micros / 1_000_000).alias("sec"))


def _is(kind: str):
    return F.col("event_type") == kind


@query(
    "asof_forward_attribution",
    f"SELECT event_id, user_id, (SELECT arg_min(p.event_id, (p.sec, p.event_id)) FROM {EV} p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.sec, p.event_id) > (e.sec, e.event_id)) AS next_event_id FROM {EV} e WHERE event_type = 'error'",
)
def asof_forward_attribution(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    return joins.asof_forward(ev, "user_id", ORDER, _is("error"), _is("purchase"), F.lit(False), "event_id").select("event_id", "user_id", "next_event_id")


@query(
    "asof_forward_with_reset",
    f"""WITH n AS (SELECT e.event_id, e.user_id, (SELECT arg_min(p.event_id, (p.sec, p.event_id)) FROM {EV} p WHERE p.user_id = e.user_id AND p.event_type IN ('purchase', 'signup') AND (p.sec, p.event_id) > (e.sec, e.event_id)) AS nxt FROM {EV} e WHERE event_type = 'error')
SELECT n.event_id, n.user_id, CASE WHEN x.event_type = 'purchase' THEN nxt END AS next_event_id FROM n LEFT JOIN events x ON x.event_id = n.nxt""",
)
def asof_forward_with_reset(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    return joins.asof_forward(ev, "user_id", ORDER, _is("error"), _is("purchase"), _is("signup"), "event_id").select("event_id", "user_id", "next_event_id")


@query(
    "asof_backward_barrier",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM {EV}),
p AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN n END IGNORE NULLS) OVER w AS tn, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS te, last_value(CASE WHEN event_type = 'error' THEN n END IGNORE NULLS) OVER w AS bn
  FROM o WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, coalesce(bn > tn, false) AS blocked, CASE WHEN NOT coalesce(bn > tn, false) THEN te END AS last_event_id FROM p WHERE event_type = 'purchase'""",
)
def asof_backward_barrier(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    return joins.asof_backward(ev, "user_id", ORDER, _is("purchase"), _is("view"), _is("error"), "event_id").select("event_id", "user_id", "blocked", "last_event_id")


@query("locf_year", f"SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM {EV}")
def locf_year(spark: SparkSession, sf: str) -> DataFrame:
    out = order.carry_down(_events(spark, sf), "user_id", ORDER, F.when(_is("signup"), F.col("event_id")), "heading")
    return out.select("event_id", "user_id", "heading")


@query(
    "gap_cluster_lines",
    f"""SELECT user_id, cluster, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM
(SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) > 43200 THEN 1 ELSE 0 END AS new FROM {EV})) GROUP BY user_id, cluster""",
)
def gap_cluster_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = order.gap_clusters(_events(spark, sf), "user_id", ORDER, F.col("sec"), 43200)
    return rows.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


@query(
    "merge_intervals",
    f"""WITH s AS (SELECT user_id, sec AS x0, sec + 7200 AS x1, event_id FROM {EV}), m AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM g GROUP BY user_id, island""",
)
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    spans = _events(spark, sf).select("user_id", F.col("sec").alias("x0"), (F.col("sec") + 7200).alias("x1"))
    return order.merge_intervals(spans, "user_id", "x0", "x1")


@query(
    "consecutive_merge",
    f"""WITH r AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type AND lag(1) OVER w IS NOT NULL THEN 1 ELSE 0 END AS new FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM r) SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run""",
)
def consecutive_merge(spark: SparkSession, sf: str) -> DataFrame:
    return order.runs(_events(spark, sf), "user_id", ORDER, "event_type")


@query(
    "neighbour_flip",
    f"SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type = 'error' AS bad, lag(event_type = 'error') OVER w AS b, lead(event_type = 'error') OVER w AS a FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) WHERE bad AND NOT b AND NOT a",
)
def neighbour_flip(spark: SparkSession, sf: str) -> DataFrame:
    return order.neighbour_flip(_events(spark, sf), "user_id", ORDER, _is("error")).select("event_id", "user_id")


@query(
    "prefix_acceptance",
    f"SELECT event_id, user_id, ok AS accepted, seen FROM (SELECT *, value > 50 AS ok, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seen FROM {EV}) WHERE seen < 3 OR (seen = 3 AND ok)",
)
def prefix_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    return order.accept_prefix(_events(spark, sf), "user_id", ORDER, F.col("value") > 50, 3).select("event_id", "user_id", "accepted", "seen")


@query("last_record_wins", f"SELECT user_id, event_type, arg_max(event_id, (sec, event_id)) AS event_id, arg_max(value, (sec, event_id)) AS value, count(*) AS n_records FROM {EV} GROUP BY user_id, event_type")
def last_record_wins(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).withColumn("at", F.struct("sec", "event_id"))
    return order.last_records(log, ["user_id", "event_type"], "at", ["event_id", "value"])


@query(
    "interval_overlap_join",
    f"SELECT a.event_id AS a_id, b.event_id AS b_id FROM {EV} a JOIN {EV} b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'error' AND a.sec + 3600 > b.sec AND a.sec < b.sec + 1800",
)
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf)
    a = ev.filter(_is("purchase")).select("user_id", F.col("event_id").alias("a_id"), F.col("sec").alias("a0"), (F.col("sec") + 3600).alias("a1"))
    b = ev.filter(_is("error")).select("user_id", F.col("event_id").alias("b_id"), F.col("sec").alias("b0"), (F.col("sec") + 1800).alias("b1"))
    return joins.overlaps(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 3600).select("a_id", "b_id")


@query(
    "nearest_band",
    "WITH b AS (SELECT p_size AS band, avg(p_retailprice) AS c FROM part GROUP BY p_size) SELECT o_orderkey, (SELECT arg_min(band, (abs(o_totalprice / 200 - c), band)) FROM b)::BIGINT AS band FROM orders",
)
def nearest_band(spark: SparkSession, sf: str) -> DataFrame:
    bands = table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("band")).agg(F.avg("p_retailprice").alias("c"))
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 200).alias("x"))
    return joins.nearest(orders, bands, "x", "band", "c").select("o_orderkey", "band")


@query(
    "gap_distribution",
    f"SELECT event_type, min(g) AS least, round(quantile_cont(g, 0.05), 6) AS p5, round(quantile_cont(g, 0.5), 6) AS median, max(g) AS most FROM (SELECT event_type, lead(sec) OVER (PARTITION BY event_type ORDER BY sec, event_id) - sec AS g FROM {EV}) WHERE g IS NOT NULL GROUP BY event_type",
)
def gap_distribution(spark: SparkSession, sf: str) -> DataFrame:
    at = order.numbered(_events(spark, sf).select("event_type", *ORDER), "event_type", ORDER, "i").select("event_type", "sec", "i")
    following = at.select("event_type", (F.col("i") - 1).alias("i"), F.col("sec").alias("following"))
    gaps = at.join(following, ["event_type", "i"]).withColumn("g", F.col("following") - F.col("sec"))
    return gaps.groupBy("event_type").agg(F.min("g").alias("least"), F.round(F.percentile("g", F.lit(0.05)), 6).alias("p5"), F.round(F.percentile("g", F.lit(0.5)), 6).alias("median"), F.max("g").alias("most"))


@query("gap_nearest_middle", f"SELECT user_id, arg_min(event_id, (abs(mid - 1705190400), event_id)) AS event_id FROM (SELECT user_id, event_id, (sec + lead(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id)) / 2.0 AS mid FROM {EV}) WHERE mid IS NOT NULL GROUP BY user_id")
def gap_nearest_middle(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    mids = _events(spark, sf).withColumn("mid", (F.col("sec") + F.lead("sec").over(w)) / 2.0).filter("mid is not null")
    return mids.groupBy("user_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("mid") - 1705190400), "event_id")).alias("event_id"))


@query("json_props_extract", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT), 0) AS missing FROM events")
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing").try_cast("long"), F.lit(0)).cast("long").alias("missing"))


@query("attribute_paths", "SELECT 'events.' || event_type || '.' || (row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) - 1) || '.user' AS path, user_id AS value FROM events")
def attribute_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = order.numbered(table(spark, sf, "events").select("event_type", "ts", "event_id", "user_id"), "event_type", ["ts", "event_id"], "i")
    return rows.select(F.concat_ws(".", F.lit("events"), "event_type", F.col("i").cast("string"), F.lit("user")).alias("path"), F.col("user_id").alias("value"))


@query("windows_tumbling", "SELECT event_type, epoch_us(ts) // 21600000000 AS slot, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL")
def windows_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ev.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return out.select("event_type", F.expr("unix_micros(w.start) div 21600000000").alias("slot"), "n", "peak")


@query("windows_sliding", "SELECT slot, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 3600000000, epoch_us(ts) // 3600000000 - 1]) AS slot FROM events) GROUP BY slot")
def windows_sliding(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.expr("unix_micros(w.start) div 3600000000").alias("slot"), "n")


@query(
    "windows_session",
    """SELECT user_id, s, count(*) AS n FROM (SELECT user_id, min(us) OVER (PARTITION BY user_id, g) // 1000000 AS s FROM (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM
(SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) >= 14400000000 THEN 1 ELSE 0 END AS new FROM events))) GROUP BY user_id, s""",
)
def windows_session(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ev.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.expr("unix_micros(w.start) div 1000000").alias("s"), "n")
