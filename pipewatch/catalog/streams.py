"""Streaming queries: the tables are replayed as files, in slices of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.catalog.decisions import _KPI
from pipewatch.catalog.medallion import _GOLD_OUT, r6
from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import rounded
from pipewatch.operators import decisions as d
from pipewatch.sources.scratch import scratch_path
from pipewatch.sources.views import table, telemetry, view
from pipewatch.streaming import landing, limits, service
from pipewatch.streaming import medallion as me

SLICES = 3


def replay(rows: DataFrame, time: str, source: str, start: Callable, slices: int = SLICES,
           late: Column | None = None) -> None:
    """Write the rows in ``slices`` parts of equal time span, running the stream after each.

    Every run picks up from the checkpoint of the one before. Rows marked
    ``late`` are delivered one slice after their time.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    width = (span["b"] - span["a"]) // slices + 1
    part = F.floor((at - span["a"]) / width)
    if late is not None:
        part = F.least(part + F.when(late, 1).otherwise(0), F.lit(slices - 1))
    for k in range(slices):
        rows.filter(part == k).write.mode("append").parquet(source)
        start().awaitTermination()


def typed_stream(spark, rows: DataFrame, source: str) -> DataFrame:
    return spark.readStream.schema(rows.schema).parquet(source)


def event_lines(spark, sf):
    """One JSON text per event; some are cut off or are no object."""
    i = F.col("event_id")
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = F.when(i % 50 == 0, F.left(whole, F.length(whole) - 3)).when(i % 77 == 0, F.lit("[1, 2]"))
    return table(spark, sf, "events").select("ts", F.coalesce(cut, whole).alias("value"))


def land_lines(spark, sf, start):
    """Write the event lines as text files and run the stream over them."""
    source = scratch_path(spark, "feed")
    event_lines(spark, sf).select("value").write.text(source)
    start(landing.text_source(spark, source)).awaitTermination()


_PARSED = "event_id long, event_type string, value double"


@query(
    "i1_raw_landing",
    """SELECT event_id, event_type, value FROM events WHERE event_id % 50 <> 0 AND event_id % 77 <> 0""",
)
def i1(spark, sf):
    target, check = scratch_path(spark, "landed"), scratch_path(spark, "check")
    land_lines(spark, sf, lambda s: landing.land_events(s.filter(landing.well_formed("value")), target, check))
    landed = spark.read.text(target)
    return landed.select(F.from_json("value", _PARSED).alias("e")).select("e.*")


@query(
    "i2_malformed_quarantine",
    """SELECT 'landed' AS kind, count(*) AS events FROM events WHERE event_id % 50 <> 0 AND event_id % 77 <> 0
       UNION ALL SELECT 'rejected', count(*) FROM events WHERE event_id % 50 = 0 OR event_id % 77 = 0""",
)
def i2(spark, sf):
    good, bad = scratch_path(spark, "landed"), scratch_path(spark, "rejected")
    check = scratch_path(spark, "check")
    land_lines(spark, sf, lambda s: landing.land_with_quarantine(s, good, bad, check))
    parts = [
        spark.read.text(path).agg(F.count(F.lit(1)).alias("events")).select(F.lit(kind).alias("kind"), "events")
        for kind, path in (("landed", good), ("rejected", bad))
    ]
    return parts[0].unionByName(parts[1])


def calls(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("client"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"),
        F.col("event_id").alias("seq"),
        "ts",
    )


# Two calls in six hours, so that the sparse test calls meet the limit.
LIMIT = {"limit": 2, "window_seconds": 6 * 3600}
CTES["calls"] = """
    SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS at_micros, event_id AS seq,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events"""
# The log holds two accepted calls at most, so its last two times say everything.
_LIMIT_SQL = """
    WITH RECURSIVE calls AS ({calls}),
    step AS (
      SELECT client, at_micros, seq, k, true AS accepted, at_micros AS last1, CAST(NULL AS BIGINT) AS last2 FROM calls WHERE k = 1
      UNION ALL
      SELECT c.client, c.at_micros, c.seq, c.k, s.last2 IS NULL OR s.last2 < c.at_micros - 21600000000 OR
          s.last1 < c.at_micros - 21600000000,
        CASE WHEN s.last2 IS NULL OR s.last2 < c.at_micros - 21600000000 OR s.last1 < c.at_micros - 21600000000
          THEN c.at_micros ELSE s.last1 END,
        CASE WHEN s.last2 IS NULL OR s.last2 < c.at_micros - 21600000000 OR s.last1 < c.at_micros - 21600000000
          THEN s.last1 ELSE s.last2 END
      FROM step s JOIN calls c ON c.client = s.client AND c.k = s.k + 1)
    SELECT client, at_micros, seq, accepted FROM step""".replace("{calls}", CTES.pop("calls"))


@query("i3_rate_limit_table", _LIMIT_SQL)
def i3_table(spark, sf):
    return limits.limit_table(calls(spark, sf), **LIMIT)


@query("i3_rate_limit_stream", _LIMIT_SQL)
def i3_stream(spark, sf):
    rows = calls(spark, sf)
    source, target, check = (scratch_path(spark, n) for n in ("calls", "answers", "check"))

    def start():
        arriving = limits.calls_source(spark, rows.schema, source)
        return limits.answer_calls(arriving.drop("ts"), target, check, **LIMIT)

    replay(rows, "ts", source, start)
    return spark.read.parquet(target)


@query(
    "i4_approval_state",
    "SELECT incident_id, approve AS approved, approver_id AS approved_by, approved_at FROM last_approval",
)
def i4(spark, sf):
    rows = view(spark, sf, "approval")
    source, target, check = (scratch_path(spark, n) for n in ("approvals", "state", "check"))
    replay(
        rows, "approved_at", source,
        lambda: service.approval_state(typed_stream(spark, rows, source), target, check),
    )
    return service.read_approvals(spark, target).select(
        "incident_id", "approved", "approved_by", "approved_at"
    )


def stream_requests(spark, sf, start):
    rows = view(spark, sf, "incident_request")
    source = scratch_path(spark, "requests")
    rows.write.parquet(source)
    start(typed_stream(spark, rows, source)).awaitTermination()


@query("i5_incident_gate", "SELECT incident_id, status, approved, approved_by FROM status_rows")
def i5(spark, sf):
    target, check = scratch_path(spark, "gated"), scratch_path(spark, "check")
    known = view(spark, sf, "approval")
    stream_requests(spark, sf, lambda s: service.incident_gate(s, known, target, check))
    return spark.read.parquet(target).select("incident_id", "status", "approved", "approved_by")


@query("i6_running_kpi", _KPI)
def i6(spark, sf):
    target, check = scratch_path(spark, "kpi"), scratch_path(spark, "check")
    known = view(spark, sf, "approval")

    def start(stream):
        return service.running_kpi(d.outcomes(d.incident_status(d.decide(stream), known)), target, check)

    stream_requests(spark, sf, start)
    rows = spark.read.parquet(target)
    newest = rows.agg(F.max("as_of_batch").alias("b")).scalar()
    return rows.filter(F.col("as_of_batch") == newest).drop("as_of_batch", "batch")


def log_stream(spark, sf, late=None):
    rows = view(spark, sf, "prediction_log").select("ts", "event_id", "status_code", "latency_ms")
    source, target, check = (scratch_path(spark, n) for n in ("log", "windows", "check"))
    replay(
        rows, "ts", source,
        lambda: service.service_window_stream(typed_stream(spark, rows, source), target, check),
        late=late,
    )
    return rows, spark.read.schema(
        "window_start timestamp, window_end timestamp, requests long, error_rate_5xx double, availability double"
    ).parquet(target)


@query(
    "i7_service_windows_stream",
    """SELECT window_start, window_end, requests, round(e, 6) AS error_rate_5xx, round(a, 6) AS availability FROM (
         SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end,
           count(*) AS requests, avg(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) AS e,
           avg(CASE WHEN coalesce(status_code, 500) < 500 THEN 1 ELSE 0 END) AS a
         FROM prediction_log GROUP BY 1, 2)
       WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM prediction_log)""",
)
def i7_stream(spark, sf):
    _, closed = log_stream(spark, sf)
    return rounded(closed)


@query(
    "i15_late_events",
    """WITH span AS (SELECT min(epoch_us(ts)) AS a, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 + 1 AS width FROM prediction_log),
       s AS (SELECT ts, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
           least((epoch_us(ts) - a) // width + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, 2) AS delivery FROM prediction_log, span),
       marks AS (SELECT d AS delivery, (SELECT max(ts) FROM s WHERE s.delivery < d) - INTERVAL 10 MINUTE AS mark FROM range(3) t(d)),
       c AS (SELECT window_start, count(*) AS arrived, count(*) FILTER (WHERE mark IS NULL OR
           window_start + INTERVAL 15 MINUTE > mark) AS counted FROM s JOIN marks ON marks.delivery = s.delivery GROUP BY 1)
       SELECT window_start, arrived, counted, arrived - counted AS late FROM c
       WHERE window_start + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM prediction_log) - INTERVAL 10 MINUTE""",
)
def i15(spark, sf):
    """Events delivered a slice late miss their windows and are counted apart."""
    late = F.col("event_id") % 10 == 3
    rows, closed = log_stream(spark, sf, late=late)
    return service.late_events(closed, rows)


_streamed: dict[tuple[str, str], me.Medallion] = {}


def streamed(spark, sf):
    """Tables of a session after the readings were replayed, delivered in order of ingestion; replayed once."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _streamed:
        return _streamed[key]
    rows = telemetry(spark, sf)
    source, bronze, check_b, check_s, root = (scratch_path(spark, n) for n in ("feed", "bronze", "check-bronze", "check-silver", "medallion"))
    nodes, metadata, links = (view(spark, sf, n) for n in ("network_nodes", "leak_metadata", "network_links"))
    # Readings are stamped with the hour they begin, so copies come within the hour.
    tables = me.Medallion(root, nodes, metadata, links, allowed=3600)

    def start():
        readings = typed_stream(spark, rows, source)
        landing.bronze_stream(
            readings, bronze, check_b, F.col("source_file"), F.col("ingest_ts")
        ).awaitTermination()
        made = spark.readStream.schema(spark.read.parquet(bronze).schema).parquet(bronze)
        return me.medallion_stream(made, tables, check_s)

    replay(rows, "ingest_ts", source, start)
    me.close(spark, tables)
    _streamed[key] = tables
    return tables


@query(
    "i13_incremental_silver",
    f"""SELECT event_ts_utc, sensor_node_id, leak_label, row_hash AS _row_hash, {r6('pressure_psi', 'flow_gpm', 'demand_gpm')}
        FROM silver_rows""",
)
def i13(spark, sf):
    silver = me.read_table(spark, streamed(spark, sf), "silver")
    return rounded(
        silver.select(
            "event_ts_utc", "sensor_node_id", "leak_label", "_row_hash", "pressure_psi", "flow_gpm", "demand_gpm"
        )
    )


@query(
    "i13_incremental_quarantine",
    """SELECT event_ts_utc, sensor_node_id, row_hash, invalid_sensor_id, leak_label_aligned,
         quarantine_reason FROM quarantine_rows""",
)
def i13_rejected(spark, sf):
    rejected = me.read_table(spark, streamed(spark, sf), "rejected")
    return rejected.select(
        "event_ts_utc", "sensor_node_id", F.col("_row_hash").alias("row_hash"), "invalid_sensor_id", "leak_label_aligned", "quarantine_reason"
    )


@query(
    "i13_incremental_gold",
    f"""SELECT event_ts_utc, sensor_node_id, leak_label, source_type AS _source_type, row_hash AS _row_hash,
          hour_of_day, day_of_week, is_weekend, node_degree, target_leak_horizon, {r6(*_GOLD_OUT)}
        FROM gold_rows""",
)
def i13_gold(spark, sf):
    gold = me.read_table(spark, streamed(spark, sf), "gold")
    return rounded(
        gold.select(
            "event_ts_utc", "sensor_node_id", "leak_label", "_source_type", "_row_hash", "hour_of_day",
            "day_of_week", "is_weekend", "node_degree", "target_leak_horizon", *_GOLD_OUT,
        )
    )
