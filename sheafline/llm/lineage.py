"""Cutting lineage on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that the planner may expect of a cut table.
LARGEST = (1 << 63) - 1


def _folder(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir); a folder of our own only where none is set and one machine does all."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(path)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder.

    checkpoint() hands on the planner's guess of the size, and a join's guess is the product of its sides'.  Where
    steps join their own results, its digits double with each step, until the number alone fills the driver's
    memory.  A guess beyond LARGEST is therefore forgotten; the planner takes its default then, which is as large.
    """
    spark = df.sparkSession
    _folder(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes() <= LARGEST:
            return out
    except ValueError:  # more digits than Python reads
        pass
    sql, none = spark.sparkContext._jvm.org.apache.spark.sql, spark.sparkContext._jvm.scala.Option.empty()
    bare = sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def drop(*tables: DataFrame | None) -> None:
    """Deletes what `cut` wrote for these tables; nothing may read them any more."""
    for df in tables:
        if df is not None:
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                remove(df.sparkSession, file.get())


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
