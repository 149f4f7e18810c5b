"""Streaming forms of the approval state, the incident gate, the KPI and windowed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipewatch.operators import decisions as d
from pipewatch.operators.alerts import service_windows
from pipewatch.plans.training import Fitted, score_batches


def _each_batch(stream: DataFrame, mode: str, work, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def approval_state(approvals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Changed incidents of every batch with their last approval so far.

    Only the incidents a batch touched are written; ``read_approvals`` takes the
    last row of each.
    """
    last = F.max(F.struct("approved_at", "seq", "approver_id", "approve"))
    latest = approvals.groupBy("incident_id").agg(last.alias("last")).select("incident_id", "last.*")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _each_batch(latest, "update", write, checkpoint)


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    return d.latest_approvals(spark.read.parquet(path).drop("batch"))


def incident_gate(requests: DataFrame, approvals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Decide streamed requests against the approvals known when they arrive."""
    decided = d.incident_status(d.decide(requests), approvals)
    return (
        decided.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_kpi(outcomes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Executive KPI after every batch; the newest batch folder holds the current figures."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("as_of_batch", F.lit(number)).write.mode("overwrite").parquet(
            f"{target}/batch={number}"
        )

    return _each_batch(d.executive_kpi(outcomes), "complete", write, checkpoint)


def service_window_stream(log: DataFrame, target: str, checkpoint: str, size: str = "15 minutes",
                          late: str = "10 minutes") -> StreamingQuery:
    """Closed windows of service metrics; events later than ``late`` are left out."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = service_windows(timed.withWatermark("ts", late), size)
    return (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_events(closed: DataFrame, log: DataFrame, size: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window that came too late: those in the log but not in the closed window.

    Windows that ended before the last watermark count; one whose events were
    all late was never closed and has none counted.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    mark = timed.agg(F.max("ts") - F.expr(f"INTERVAL {late}")).scalar()
    everything = service_windows(timed, size).filter(F.col("window_end") <= mark)
    counted = closed.select("window_start", F.col("requests").alias("counted"))
    joined = everything.select("window_start", F.col("requests").alias("arrived")).join(counted, "window_start", "left")
    return joined.withColumn("counted", F.coalesce("counted", F.lit(0).cast("long"))).withColumn(
        "late", F.col("arrived") - F.col("counted")
    )


def score_requests(requests: DataFrame, fitted: Fitted, target: str, checkpoint: str) -> StreamingQuery:
    """Predictions for streamed requests, each one message: (batch_id, rows of (row_index, payload)).

    A request comes whole, so its check and the scaling of its scores need no state and no later
    message. A batch that is run again replaces its own folder, so no answer is written twice.
    """
    answered = requests.select("batch_id", F.explode("rows").alias("row")).select("batch_id", "row.row_index", "row.payload")

    def write(batch: DataFrame, number: int) -> None:
        score_batches(batch, fitted).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _each_batch(answered, "append", write, checkpoint)
