"""Sliding rate limit per client, as a stream and over a table."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pipewatch.operators.series import over_series, running_max

# Executors get the admission rule with the task, without this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_REQUESTS = 60
WINDOW_SECONDS = 60
IDLE_SECONDS = 24 * 3600
OUT = "client string, at_micros long, seq long, accepted boolean"
#: Answers handed on at once.
FRAME = 10_000
# Expiring state needs this store. Batches without calls have nothing to answer; with them a run would never end.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def admit(log: deque, at: int, window: int, limit: int) -> bool:
    """Drop calls older than the window, then accept and record this one if there is room."""
    while log and log[0] < at - window:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(at)
    return True


def calls_source(spark: SparkSession, schema, folder: str, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Streamed calls in micro-batches of a fixed size, which bounds what one client brings at once."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(folder)


class Admission(StatefulProcessor):
    """Answers the calls of a client; its accepted calls inside the window are a list that expires when the client is idle."""

    def __init__(self, limit: int, window_seconds: int, idle_seconds: int):
        self.limit, self.window, self.idle = limit, window_seconds * 1_000_000, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("accepted", "at_micros long", ttlDurationMs=self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Two numbers per call of this micro-batch; the frames themselves are let go.
        numbers = [f[["at_micros", "seq"]].to_numpy(dtype=np.int64) for f in rows]
        calls = np.vstack(numbers)
        calls = calls[np.lexsort((calls[:, 1], calls[:, 0]))]
        log = deque(r[0] for r in self.log.get()) if self.log.exists() else deque()
        for start in range(0, len(calls), FRAME):
            part = calls[start : start + FRAME]
            answers = [admit(log, at, self.window, self.limit) for at in part[:, 0].tolist()]
            yield pd.DataFrame({"client": key[0], "at_micros": part[:, 0], "seq": part[:, 1], "accepted": answers})
        if log:
            self.log.put([(at,) for at in log])

    def close(self) -> None:
        pass


def limit_stream(calls: DataFrame, limit: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS,
                 idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Accept or reject streamed calls (client, at_micros, seq).

    A client's state is its accepted calls inside the window, ``limit`` numbers at most, and is gone ``idle_seconds``
    of working time after its last call. That should exceed the window by as much as the stream may lag behind.
    Calls of one micro-batch are taken in time order, so the source should bound its micro-batches, as ``calls_source`` does.
    """
    return calls.groupBy("client").transformWithStateInPandas(
        Admission(limit, window_seconds, idle_seconds), OUT, "Append", "ProcessingTime"
    )


def answer_calls(calls: DataFrame, target: str, checkpoint: str, **settings: int) -> StreamingQuery:
    """Answer all calls that are new, into the table at ``target``. The settings a query needs hold for this one only."""
    conf = calls.sparkSession.conf
    before = {name: conf.get(name, None) for name in STREAM_CONF}
    for name, value in STREAM_CONF.items():
        conf.set(name, value)
    try:
        return (
            limit_stream(calls, **settings)
            .writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def limit_table(calls: DataFrame, limit: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same answers over a table of calls.

    A pause longer than the window empties a client's log, so calls between
    two pauses stand alone: they are spread over tasks by (client, start), and
    each task reads its calls in order, holding ``limit`` numbers at a time.
    """
    window = window_seconds * 1_000_000
    order = [F.col("at_micros").asc(), F.col("seq").asc()]
    calls = calls.select("client", "at_micros", "seq")

    def starts(rows: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.lag("at_micros").over(w)
        fresh = before.isNull() | (F.col("at_micros") - before > window)
        return rows.withColumn("_start", F.when(fresh, F.col("at_micros")))

    marked = over_series(calls, "client", order, starts, lookback=1)
    spans = running_max(marked, "client", order, "_start", "_span")
    ordered = spans.drop("_start").repartition("client", "_span").sortWithinPartitions(
        "client", "_span", "at_micros", "seq"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for batch in batches:
            answers = []
            for client, span, at in zip(batch["client"], batch["_span"], batch["at_micros"]):
                if (client, span) != current:
                    current, log = (client, span), deque()
                answers.append(admit(log, int(at), window, limit))
            yield batch.assign(accepted=answers)[["client", "at_micros", "seq", "accepted"]]

    return ordered.mapInPandas(run, OUT)
