"""Streaming queries run to the end of what is there (availableNow); each gives what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..streaming import jobs, recovery
from .registry import query, table

#: Event types as job states.
STATES = {"view": "pending", "click": "intended", "signup": "submitted", "purchase": "completed", "error": "errored"}


def _log(df: DataFrame) -> DataFrame:
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event_type")]
    return df.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job"), F.col("event_id").alias("offset"), state.alias("state"), (F.col("event_id") % 5).cast("int").alias("attempt"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    batch = table(spark, sf, "events")
    return _log(spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parquet*"))


def _run(spark: SparkSession, stream: DataFrame, mode: str, key: str = "job") -> DataFrame:
    """Runs a stream to its end; every batch is a table in the shared folder. complete: the last one; update: each key's last row; append: all."""
    at = files.shared_folder(spark)
    cols = stream.columns
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/rows")
    if mode == "append":
        return rows.select(*cols)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("last"))
        return rows.join(last, F.col("batch") == F.col("last")).select(*cols)
    return rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in cols if c != key]).select(*cols)


LOG_SQL = "(SELECT 'u' || user_id AS job, event_id AS off, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'intended' WHEN 'signup' THEN 'submitted' WHEN 'purchase' THEN 'completed' ELSE 'errored' END AS state, (event_id % 5)::INT AS attempt FROM events)"


@query("stream_last_state", f"SELECT job, arg_max(state, off) AS state, arg_max(attempt, off) AS attempt, count(*) AS n_records FROM {LOG_SQL} GROUP BY job")
def stream_last_state(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, jobs.last_state(_stream(spark, sf)), "update")


@query("job_last_state", f"SELECT job, arg_max(state, off) AS state, arg_max(attempt, off) AS attempt, count(*) AS n_records FROM {LOG_SQL} GROUP BY job")
def job_last_state(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.last_state(_log(table(spark, sf, "events")))


@query("job_resubmission", f"SELECT job, attempt + 1 AS attempt FROM (SELECT job, arg_max(state, off) AS state, arg_max(attempt, off) AS attempt FROM {LOG_SQL} GROUP BY job) WHERE state IN ('pending', 'expired', 'errored')")
def job_resubmission(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.submit_again(jobs.last_state(_log(table(spark, sf, "events"))))


@query(
    "job_transitions",
    f"""SELECT coalesce(b, 'new') AS before, state AS after, count(*) AS n, CASE coalesce(b, 'new') WHEN 'new' THEN state = 'pending' WHEN 'pending' THEN state = 'intended' WHEN 'intended' THEN state IN ('submitted', 'intended') WHEN 'submitted' THEN state IN ('completed', 'expired', 'errored') WHEN 'errored' THEN state = 'intended' ELSE false END AS legal
FROM (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY off) AS b FROM {LOG_SQL}) GROUP BY ALL""",
)
def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    log = _log(table(spark, sf, "events"))
    steps = log.withColumn("b", F.lag("state").over(Window.partitionBy("job").orderBy("offset")))
    out = steps.groupBy(F.coalesce("b", F.lit("new")).alias("before"), F.col("state").alias("after")).agg(F.count("*").alias("n"))
    return out.withColumn("legal", jobs.legal(F.when(F.col("before") != "new", F.col("before")), F.col("after")))


@query(
    "job_recovery",
    f"""WITH s AS (SELECT job, arg_max(state, off) AS state FROM {LOG_SQL} GROUP BY job) SELECT CASE WHEN CAST(substr(job, 2) AS BIGINT) // 10 % 2 = 0 THEN 'adopt' ELSE 'send again' END AS action, count(*) AS n, count(DISTINCT CAST(substr(job, 2) AS BIGINT) // 10) AS n_tokens FROM s WHERE state = 'intended' GROUP BY 1""",
)
def job_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Intended jobs, ten to a token; the service knows every other token."""
    tens = F.expr("cast(substr(job, 2) as bigint) div 10")
    states = jobs.last_state(_log(table(spark, sf, "events"))).withColumn("token", tens.cast("string")).withColumn("batch", F.lit(None).cast("string"))
    known = states.select("token").distinct().filter("cast(token as bigint) % 2 = 0").withColumn("batch", F.concat(F.lit("b"), F.col("token")))
    return recovery.recovered(states, known).groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_tokens"))


@query("seed_conflicts", f"SELECT (CAST(substr(job, 2) AS BIGINT) % 3)::INT AS seed, count(*) AS n FROM (SELECT job, arg_max(state, off) AS state FROM {LOG_SQL} GROUP BY job) WHERE CAST(substr(job, 2) AS BIGINT) % 3 <> 1 AND state <> 'completed' GROUP BY 1")
def seed_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds other than 1 with unfinished jobs."""
    states = jobs.last_state(_log(table(spark, sf, "events"))).withColumn("seed", F.expr("cast(cast(substr(job, 2) as bigint) % 3 as int)"))
    return recovery.conflicts(states, 1)


@query("stream_state_machine")
def stream_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, jobs.machine(_stream(spark, sf)), "update")


@query("stream_dedup", f"SELECT DISTINCT job FROM {LOG_SQL}")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, jobs.first_results(_stream(spark, sf), "ts", "60 days").select("job"), "append")


@query("stream_tumbling", "SELECT epoch_us(ts) // 86400000000 AS day, max(value) AS peak, count(*) AS n FROM events GROUP BY 1")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.peaks(_stream(spark, sf), "ts", "60 days", "1 day", "value")
    return _run(spark, out, "complete").select(F.expr("unix_micros(start) div 86400000000").alias("day"), "peak", "n")
