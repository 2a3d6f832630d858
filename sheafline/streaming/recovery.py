"""One run of a seed's jobs over a service that answers in batches: intents are written before they are sent, so a crash loses and doubles nothing.

The log is a table of rows (cell, seed, question, offset, state, attempt, token, batch); a job's last row is its state.  Steps are set
operations on the last states; only tokens and batches, a few per run, are looped over on the driver.
"""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .jobs import submit_again, token

LOG = "cell string, seed int, question string, offset long, state string, attempt int, token string, batch string"
KEY = ["cell", "seed", "question"]
UNFINISHED = ("pending", "intended", "submitted", "expired", "errored")


class SeedConflict(RuntimeError):
    """Another seed has unfinished jobs, or a later seed is not confirmed."""


class Service(Protocol):
    def submit(self, jobs: DataFrame, token: str) -> str: ...  # the batch's id

    def find(self, token: str) -> str | None: ...

    def ended(self, batch: str) -> bool: ...

    def results(self, spark: SparkSession, batch: str) -> DataFrame: ...  # job, type, payload


class Summary(NamedTuple):
    done_before: int
    adopted: int
    sent_again: int
    collected: int
    submitted: int


def job_id() -> Column:
    """40 hex digits that stand for a job's key in a batch."""
    return F.substring(F.sha2(F.concat_ws("|", "cell", F.col("seed").cast("string"), "question"), 256), 1, 40)


def last(log: DataFrame) -> DataFrame:
    """The last row of each job, with its id."""
    rest = ["state", "attempt", "token", "batch"]
    return log.groupBy(*KEY).agg(F.max("offset").alias("offset"), *[F.max_by(F.struct(*rest), "offset").alias("s")]).select(*KEY, "offset", *[F.col(f"s.{c}").alias(c) for c in rest]).withColumn("job", job_id())


def conflicts(states: DataFrame, seed: int) -> DataFrame:
    """Other seeds with unfinished jobs, and how many."""
    return states.filter((F.col("seed") != seed) & F.col("state").isin(*UNFINISHED)).groupBy("seed").agg(F.count("*").alias("n"))


def recovered(states: DataFrame, known: DataFrame) -> DataFrame:
    """Intended jobs with what to do: adopt the batch that the service has for their token, or send again under the same token. known: token, batch."""
    there = known.select("token", F.col("batch").alias("_found_"))
    out = states.filter("state = 'intended'").drop("batch").join(there, "token", "left")
    return out.withColumn("action", F.when(F.col("_found_").isNotNull(), "adopt").otherwise("send again")).withColumnRenamed("_found_", "batch")


class Run:
    """A log and a result sink in two folders, and a service."""

    def __init__(self, spark: SparkSession, log: str, results: str, service: Service) -> None:
        self.spark, self.log, self.results, self.service = spark, log, results, service

    def states(self) -> DataFrame:
        rows = self.spark.read.schema(LOG).parquet(self.log) if files.exists(self.spark, self.log) else self.spark.createDataFrame([], LOG)
        return last(rows)

    def _append(self, jobs: DataFrame, **changed: object) -> None:
        """Rows of jobs with changed columns, after all that stands in the log; written before this returns."""
        at = (self.states().agg(F.max("offset").alias("m")).first()["m"] or 0) + 1
        kinds = dict(x.split() for x in LOG.split(", "))
        rows = jobs.withColumns({c: F.lit(v).cast(kinds[c]) for c, v in changed.items()} | {"offset": F.lit(at)})
        rows.select(*[F.col(c).cast(k) for c, k in kinds.items()]).write.mode("append").parquet(self.log)

    def _submit(self, jobs: DataFrame, token_: str) -> None:
        batch = self.service.submit(jobs, token_)
        self._append(jobs, state="submitted", token=token_, batch=batch)

    def seed(self, design: DataFrame, seed: int, first: int = 1, confirmed: bool = False) -> Summary:
        """Recovers, collects, then submits what is left. design: cell, question."""
        if seed != first and not confirmed:
            raise SeedConflict(f"seed {seed} needs confirmation")
        if (other := conflicts(self.states(), seed).orderBy("seed").first()) is not None:
            raise SeedConflict(f"seed {other['seed']} has {other['n']} unfinished jobs")
        wanted = design.select("cell", F.lit(seed).alias("seed"), "question")
        fresh = wanted.join(self.states(), KEY, "left_anti")
        blank = {c: F.lit(None).cast("string") for c in ("token", "batch")}
        if not fresh.isEmpty():
            self._append(fresh.withColumns(blank), state="pending", attempt=0)
        mine = lambda: self.states().filter(F.col("seed") == seed)
        done = mine().filter("state = 'completed'").count()
        adopted = again = collected = 0
        for r in mine().filter("state = 'intended'").groupBy("token").agg(F.count("*").alias("n")).orderBy("token").collect():
            jobs = mine().filter((F.col("state") == "intended") & (F.col("token") == r["token"]))
            if (batch := self.service.find(r["token"])) is not None:
                self._append(jobs, state="submitted", batch=batch)
                adopted += r["n"]
            else:  # it never arrived: safe to send again under the same token
                self._submit(jobs, r["token"])
                again += r["n"]
        for (batch,) in mine().filter("state = 'submitted'").select("batch").distinct().orderBy("batch").collect():
            if not self.service.ended(batch):
                continue
            jobs = mine().filter((F.col("state") == "submitted") & (F.col("batch") == batch))
            got = jobs.join(self.service.results(self.spark, batch).dropDuplicates(["job"]), "job", "left")  # a job without a result counts as errored
            good = got.filter("type = 'succeeded'")
            files.append_new(good.select(*KEY, "job", "batch", "type", "payload"), self.results, "job")
            collected += good.count()
            state = F.when(F.col("type") == "succeeded", "completed").when(F.col("type") == "expired", "expired").otherwise("errored")
            self._append(got.withColumn("state", state))
        todo = submit_again(mine().select("job", "state", "attempt")).withColumnRenamed("attempt", "_next_")
        jobs = mine().join(todo, "job").withColumn("attempt", F.col("_next_"))
        n = jobs.count()
        if n:
            sent = token(jobs.select("job", "attempt")).first()["token"]
            self._append(jobs.withColumn("batch", blank["batch"]), state="intended", token=sent)
            self._submit(mine().filter((F.col("state") == "intended") & (F.col("token") == sent)), sent)
        return Summary(done, adopted, again, collected, n)
