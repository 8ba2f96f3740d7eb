"""The job log: states of jobs from their events, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Which event moves a job to which state.
STATES = {"click": "queued", "view": "running", "purchase": "succeeded"}
ATTEMPTS = 2


def with_state(events: DataFrame) -> DataFrame:
    state = F.lit("failed")
    for event, name in STATES.items():
        state = F.when(F.col("event_type") == event, name).otherwise(state)
    return events.withColumn("state", state)


def states_of(events: DataFrame) -> DataFrame:
    """job, its last state, its failures and events. Works on streams in complete or update mode too."""
    logged = with_state(events)
    return logged.groupBy(F.col("user_id").alias("job")).agg(F.max_by("state", "event_id").alias("state"), F.count_if(F.col("state") == "failed").alias("failures"), F.count(F.lit(1)).alias("n_events"))


def new_jobs(submitted: DataFrame, known: DataFrame) -> DataFrame:
    """Submitted jobs (job, content) that haven't succeeded before, once each: submitting again changes nothing."""
    return submitted.dropDuplicates(["job"]).join(known.where("state = 'succeeded'").select("job"), "job", "left_anti")


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a crash: those queued or running are queued again, or failed after ATTEMPTS."""
    open_ = F.col("state").isin("queued", "running")
    return jobs.withColumns({"state": F.when(open_ & (F.col("attempts") >= ATTEMPTS), "failed").when(open_, "queued").otherwise(F.col("state")), "attempts": F.when(open_, F.col("attempts") + 1).otherwise(F.col("attempts"))})


def heartbeats(events: DataFrame, now: str, patience: str = "1 minute") -> DataFrame:
    """events: job and ts of signs of life, a stream (with a watermark) or a batch. Each job's last one, and whether it is late at a time."""
    return events.groupBy("job").agg(F.max("ts").alias("alive")).withColumn("late", F.col("alive") < F.to_timestamp(F.lit(now)) - F.expr(f"interval {patience}"))


def work(spark: SparkSession, inbox: str, schema: StructType, log: str, checkpoint: str, job: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """The worker: files of submitted jobs (job, content), oldest first and one at a time, each run once by job, which gives job and state.

    A batch's states are written to a folder of its own under log, so a batch that is run again after a crash replaces what it
    wrote; jobs that an earlier batch has brought to success are not run again.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = status(spark, log, before=number)
        todo = new_jobs(batch, done) if done is not None else batch.dropDuplicates(["job"])
        try:
            rows = job(todo).select("job", "state").withColumn("error", F.lit(None).cast("string"))
            rows.write.mode("overwrite").parquet(f"{log}/batch={number:012d}")
        except Exception as e:  # noqa: BLE001  a job that fails must not stop those behind it
            failed = todo.select("job", F.lit("failed").alias("state"), F.lit(str(e)[:1000]).alias("error"))
            failed.write.mode("overwrite").parquet(f"{log}/batch={number:012d}")

    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(inbox)
    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(spark: SparkSession, log: str, before: int | None = None) -> DataFrame | None:
    """The last state of every job in a worker's log, with its error; None for a log without batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema("job string, state string, error string, batch long").option("basePath", log).parquet(log)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("job").agg(F.max_by("state", "batch").alias("state"), F.max_by("error", "batch").alias("error"), F.count_if(F.col("state") == "failed").alias("failures"))


def stream(spark: SparkSession, path: str, schema: StructType, name: str, checkpoint: str) -> StreamingQuery:
    """States of the jobs of an event folder, one file at a time, kept in a memory table."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return states_of(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
