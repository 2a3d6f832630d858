"""The job log as a stream: last state per key, legal transitions, idempotent results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Legal next states (fixed values): completed is terminal; expired and errored may be sent again.
NEXT = {
    None: ("pending",),
    "pending": ("intended",),
    "intended": ("submitted", "intended"),
    "submitted": ("completed", "expired", "errored"),
    "expired": ("intended",),
    "errored": ("intended",),
    "completed": (),
}


def legal(before: Column, after: Column) -> Column:
    """May a job go from one state to the other? null: it is new."""
    table = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k or "new"), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, F.coalesce(before, F.lit("new"))), after), F.lit(False))


def last_state(log: DataFrame) -> DataFrame:
    """Streaming or batch: state and attempt of the last record of each key (job, offset, state, attempt)."""
    return log.groupBy("job").agg(F.max_by("state", "offset").alias("state"), F.max_by("attempt", "offset").alias("attempt"), F.count("*").alias("n_records"))


def submit_again(states: DataFrame) -> DataFrame:
    """Jobs that the next submission takes, with their attempt: pending, expired and errored."""
    return states.filter(F.col("state").isin("pending", "expired", "errored")).select("job", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"))


def token(jobs: DataFrame) -> DataFrame:
    """One token for a submission: 32 hex digits over its ordered job:attempt pairs (jobs of one submission are few)."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "job", F.col("attempt").cast("string"))))
    return jobs.agg(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 32).alias("token"))


_OUT = "job string, state string, attempt int, n_illegal long"
_STATE = "state string, attempt int, last long, n_illegal long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, attempt, last, bad = state.get if state.exists else (None, 0, -1, 0)
    rows = pd.concat(list(frames)).sort_values("offset")
    for offset, to in zip(rows["offset"], rows["state"], strict=True):
        if offset <= last:  # seen before: a replayed batch changes nothing
            continue
        last = int(offset)
        if to in NEXT[now]:
            attempt += to == "submitted"
            now = to
        else:
            bad += 1
    state.update((now, int(attempt), last, int(bad)))
    yield pd.DataFrame([(key[0], now, int(attempt), int(bad))], columns=["job", "state", "attempt", "n_illegal"])


def machine(log: DataFrame) -> DataFrame:
    """The state machine over a stream (job, offset, state): illegal steps are counted and ignored, replays too."""
    return log.select("job", "offset", "state").groupBy("job").applyInPandasWithState(_advance, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def first_results(results: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Each job's result once; repeats within the watermark are dropped."""
    return results.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["job"])


def write_once(batch: DataFrame, path: str, key: str = "job") -> int:
    """Appends rows whose key the sink does not hold yet (for foreachBatch); returns 0 if there were none."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # the sink's first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if new.isEmpty():
        return 0
    new.write.mode("append").parquet(path)
    return 1


def peaks(samples: DataFrame, event_time: str, delay: str, width: str, value: str) -> DataFrame:
    """Tumbling maxima with a watermark."""
    out = samples.withWatermark(event_time, delay).groupBy(F.window(event_time, width)).agg(F.max(value).alias("peak"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "peak", "n")
