"""A serial job queue over a landing folder, with Structured Streaming: one file a batch, in order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOB = "job_id string, mode string, target string, enqueued_at timestamp"
STATES = ("queued", "running", "done", "error")


def job_log(spark: SparkSession, states: str) -> DataFrame:
    """All recorded states: ``(job_id, mode, target, enqueued_at, status, place, detail, at, batch)``."""
    return spark.read.parquet(states)


def job_states(log: DataFrame) -> DataFrame:
    """The latest state of each job: the last batch that recorded one, and in it the last step."""
    newest = log.groupBy("job_id").agg(F.max_by(F.struct("mode", "target", "enqueued_at", "status", "detail", "at"), F.struct("batch", "place")).alias("s"))
    return newest.select("job_id", "s.*")


def run_queue(spark: SparkSession, landing: str, states: str, checkpoint: str, work: Callable[[DataFrame], None], enrich: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Starts a query that does ``work`` on each landed file of jobs in turn and stops when none is left.

    A failure of ``work`` records an error for the batch's jobs and the queue goes on; a failure of ``enrich``, which
    follows, only leaves a note. A batch that is run again after a crash replaces what it recorded before, so states
    are never double; ``work`` has to be idempotent for the same reason.
    """

    def batch(jobs: DataFrame, number: int) -> None:
        def note(status: str, detail: str | None) -> None:
            rows = jobs.select("job_id", "mode", "target", "enqueued_at", F.lit(status).alias("status"), F.lit(STATES.index(status)).alias("place"), F.lit(detail).cast("string").alias("detail"), F.current_timestamp().alias("at"))
            rows.write.mode("overwrite").parquet(f"{states}/batch={number}/step={STATES.index(status)}")

        note("queued", None)
        note("running", None)
        try:
            work(jobs)
        except Exception as e:  # noqa: BLE001 - the job failed, not the queue
            note("error", f"{type(e).__name__}: {e}"[:400])
            return
        detail = None
        if enrich is not None:
            try:
                enrich(jobs)
            except Exception as e:  # noqa: BLE001 - what follows the job cannot fail it
                detail = f"enrichment failed: {type(e).__name__}: {e}"[:400]
        note("done", detail)

    stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).json(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_history(spark: SparkSession, landing: str, history: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Starts a query that appends landed JSON rows to a Parquet table exactly once and stops when none is left."""
    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.format("parquet").option("path", history).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
