"""Monitoring, drift and alert queries over the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog.medallion import gold_frame
from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import rounded
from pipewatch.operators import alerts as al
from pipewatch.operators import monitoring as mo
from pipewatch.sources import schemas
from pipewatch.sources.readers import read_jsonl_maps
from pipewatch.sources.scratch import scratch_path
from pipewatch.sources.views import table, view

CTES["current_log"] = "SELECT * FROM prediction_log WHERE side = 'current'"


def log(spark, sf):
    return view(spark, sf, "prediction_log")


def current(spark, sf):
    return log(spark, sf).filter("side = 'current'")


def log_lines(spark, sf):
    """The log as JSON text: status absent when unknown, labels present but null,
    key order varying, one key only before and one only after the change of side."""
    label = F.coalesce(F.col("actual_label").cast("string"), F.lit("null"))
    parts = [
        F.concat(F.lit('"latency_ms": '), F.round("latency_ms").cast("string")),
        F.concat(F.lit('"actual_label": '), label),
    ]
    odd = F.col("event_id") % 2 == 1
    body = F.when(odd, F.concat_ws(", ", *parts)).otherwise(F.concat_ws(", ", *parts[::-1]))
    status = F.when(
        F.col("status_code").isNotNull(), F.concat(F.lit('"status_code": '), F.col("status_code"))
    )
    side_key = F.when(F.col("side") == "baseline", '"legacy_flag": 1').otherwise('"region": "N"')
    line = F.concat(F.lit("{"), F.concat_ws(", ", body, status, side_key), F.lit("}"))
    return log(spark, sf).select("side", line.alias("value"))


def log_files(spark, sf):
    """Both sides written as JSON lines, read back as map rows."""
    path = scratch_path(spark, "prediction-log")
    log_lines(spark, sf).write.partitionBy("side").text(path)
    return read_jsonl_maps(spark, f"{path}/side=baseline"), read_jsonl_maps(
        spark, f"{path}/side=current"
    )


_QUALITY = """
    SELECT count(*) AS "rows", CAST(count(*) * 3 + count(status_code) AS BIGINT) AS cells,
      count(*) FILTER (WHERE actual_label IS NULL) AS missing_cells,
      (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM current_log
         GROUP BY round(latency_ms), actual_label, status_code)) AS duplicate_rows FROM current_log"""
CTES["quality_row"] = f"""
    SELECT *, missing_cells / cells AS missing_rate, duplicate_rows / "rows" AS duplicate_rate FROM ({_QUALITY})"""


def _tail(q: float, frm: str = "current_log") -> str:
    return f"""(SELECT latency_ms FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS r,
        count(*) OVER () AS n FROM {frm}) WHERE r = floor({q} * (n - 1)))"""


@query(
    "d23_latency",
    f"""SELECT round(avg(latency_ms), 6) AS average_latency_ms, {_tail(0.95)} AS p95_latency_ms,
          {_tail(0.99)} AS p99_latency_ms FROM current_log""",
)
def d23(spark, sf):
    return rounded(mo.latency(current(spark, sf)))


_SERVICE = """count(latency_ms) / greatest(sum(latency_ms) / 1000, 1e-9) AS throughput_rps_estimate,
    avg(CASE WHEN coalesce(status_code, 200) >= 400 THEN 1 ELSE 0 END) AS error_rate,
    avg(CASE WHEN coalesce(status_code, 500) < 500 THEN 1 ELSE 0 END) AS availability"""


@query(
    "d24_throughput",
    f"SELECT round(throughput_rps_estimate, 6) AS throughput_rps_estimate FROM (SELECT {_SERVICE} FROM current_log)",
)
def d24(spark, sf):
    name = "throughput_rps_estimate"
    return rounded(current(spark, sf).agg(mo.SERVICE[name]().alias(name)))


@query(
    "d25_error_rate_availability",
    f"""SELECT round(error_rate, 6) AS error_rate, round(availability, 6) AS availability
        FROM (SELECT {_SERVICE} FROM current_log)""",
)
def d25(spark, sf):
    return rounded(
        current(spark, sf).agg(
            *[mo.SERVICE[n]().alias(n) for n in ("error_rate", "availability")]
        )
    )


@query(
    "d26_resources",
    """SELECT round(avg(cpu_percent), 6) AS avg_cpu_percent, round(avg(memory_percent), 6) AS avg_memory_percent
       FROM current_log""",
)
def d26(spark, sf):
    return rounded(current(spark, sf).agg(*mo.measures(mo.RESOURCES)))


@query("d27_missing_rate", "SELECT cells, missing_cells, round(missing_rate, 6) AS missing_rate FROM quality_row")
def d27(spark, sf):
    _, now = log_files(spark, sf)
    return rounded(mo.row_quality(now).select("cells", "missing_cells", "missing_rate"))


@query(
    "d28_duplicate_rate",
    'SELECT "rows", duplicate_rows, round(duplicate_rate, 6) AS duplicate_rate FROM quality_row',
)
def d28(spark, sf):
    _, now = log_files(spark, sf)
    return rounded(mo.row_quality(now).select("rows", "duplicate_rows", "duplicate_rate"))


@query(
    "g5_schema_changes",
    """SELECT 'added' AS change, 'region' AS column_name WHERE EXISTS (FROM current_log)
       UNION ALL SELECT 'removed', 'legacy_flag' WHERE EXISTS (SELECT 1 FROM prediction_log WHERE side = 'baseline')""",
)
def g5(spark, sf):
    return mo.schema_changes(*log_files(spark, sf))


def psi_sql(rows: str, period: str = "") -> str:
    """PSI per feature (and period) of long rows (feature, side, value)."""
    p = f", {period}" if period else ""
    return f"""
      v AS (SELECT * FROM ({rows}) WHERE value IS NOT NULL),
      lim AS (SELECT feature, min(value) AS low, max(value) AS high FROM v GROUP BY feature),
      b AS (SELECT v.*, low, high, least(CAST(floor((value - low) / ((high - low) / 10)) AS INTEGER), 9) AS bin
            FROM v JOIN lim ON lim.feature = v.feature WHERE high > low),
      base AS (SELECT feature, bin, count(*) AS c FROM b WHERE side = 'baseline' GROUP BY 1, 2),
      curr AS (SELECT feature, bin{p}, count(*) AS c FROM b WHERE side = 'current' GROUP BY feature, bin{p}),
      nb AS (SELECT feature, sum(c) AS n FROM base GROUP BY 1),
      nc AS (SELECT feature{p}, sum(c) AS n FROM curr GROUP BY feature{p}),
      cells AS (SELECT nc.feature{", nc." + period if period else ""},
          greatest(coalesce(base.c, 0) / nb.n, 1e-9) AS br, greatest(coalesce(curr.c, 0) / nc.n, 1e-9) AS cr
        FROM nc JOIN nb ON nb.feature = nc.feature CROSS JOIN range(10) k(bin)
        LEFT JOIN base ON base.feature = nc.feature AND base.bin = k.bin
        LEFT JOIN curr ON curr.feature = nc.feature AND curr.bin = k.bin
          {f"AND curr.{period} = nc.{period}" if period else ""}),
      psi AS (SELECT feature{p}, sum((cr - br) * ln(cr / br)) AS psi FROM cells GROUP BY feature{p})"""


_LOG_LONG = """SELECT 'score' AS feature, side, score AS value, CAST(ts AS DATE) AS day FROM prediction_log
    UNION ALL SELECT 'confidence', side, confidence, CAST(ts AS DATE) FROM prediction_log"""


@query(
    "d29_psi",
    f"WITH {psi_sql(_LOG_LONG)} SELECT feature, round(psi, 6) AS psi FROM psi",
)
def d29(spark, sf):
    return rounded(mo.psi_by_feature(mo.long_features(log(spark, sf), ["score", "confidence"])))


_GOLD_LONG = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, CASE WHEN event_ts_utc < TIMESTAMP '2024-01-16 00:00:00' THEN 'baseline'
        ELSE 'current' END AS side, {f} AS value FROM gold_rows"""
    for f in schemas.MODEL_FEATURES
)


@query(
    "d30_feature_drift",
    f"WITH {psi_sql(_GOLD_LONG)} SELECT feature, round(psi, 6) AS psi, psi > 0.2 AS drifted FROM psi",
)
def d30(spark, sf):
    cut = F.lit("2024-01-16").cast("timestamp")
    sided = gold_frame(spark, sf).withColumn(
        "side", F.when(F.col("event_ts_utc") < cut, "baseline").otherwise("current")
    )
    return rounded(mo.feature_drift(sided, list(schemas.MODEL_FEATURES)))


_OUTCOMES = """count(*) FILTER (WHERE actual_label = 0 AND predicted_label = 1)
        / greatest(count(*) FILTER (WHERE actual_label = 0), 1) AS false_alarm_rate,
    count(*) FILTER (WHERE actual_label = 1 AND predicted_label = 0)
        / greatest(count(*) FILTER (WHERE actual_label = 1), 1) AS missed_leak_rate,
    coalesce(avg(detection_delay_minutes) FILTER (WHERE actual_label IN (0, 1)), 0) AS avg_detection_delay_minutes,
    coalesce(avg(estimated_business_impact_usd), 0) AS avg_business_impact_usd"""
_OUTCOME_NAMES = list(mo.OUTCOMES)


def r6(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("d31_outcome_quality", f"SELECT {r6(_OUTCOME_NAMES)} FROM (SELECT {_OUTCOMES} FROM current_log)")
def d31(spark, sf):
    return rounded(current(spark, sf).agg(*mo.measures(mo.OUTCOMES)))


_REPORT_FLOATS = [
    "average_latency_ms", "throughput_rps_estimate", "error_rate", "availability", "avg_cpu_percent",
    "avg_memory_percent", *_OUTCOME_NAMES, "p95_latency_ms", "p99_latency_ms", "missing_rate",
    "duplicate_rate", "prediction_drift_psi", "confidence_drift_psi",
]
REPORT_SQL = f"""WITH {psi_sql(_LOG_LONG)}, report AS (SELECT avg(latency_ms) AS average_latency_ms, {_SERVICE}, {_OUTCOMES},
      avg(cpu_percent) AS avg_cpu_percent, avg(memory_percent) AS avg_memory_percent,
      {_tail(0.95)} AS p95_latency_ms, {_tail(0.99)} AS p99_latency_ms,
      (SELECT missing_rate FROM quality_row) AS missing_rate, (SELECT duplicate_rate FROM quality_row) AS duplicate_rate,
      'region' AS added_columns, 'legacy_flag' AS removed_columns,
      (SELECT psi FROM psi WHERE feature = 'score') AS prediction_drift_psi,
      (SELECT psi FROM psi WHERE feature = 'confidence') AS confidence_drift_psi FROM current_log)"""


def report(spark, sf):
    return mo.monitoring_report(log(spark, sf), *log_files(spark, sf))


@query(
    "d32_monitoring_report",
    f"{REPORT_SQL} SELECT added_columns, removed_columns, {r6(_REPORT_FLOATS)} FROM report",
)
def d32(spark, sf):
    return rounded(report(spark, sf))


@query(
    "d36_request_summary",
    f"""SELECT count(*) AS requests, count(*) FILTER (WHERE status_code = 200) AS successes,
          round(count(*) FILTER (WHERE status_code = 200) / count(*), 6) AS success_rate,
          round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_seconds,
          round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS throughput_rps,
          round(avg(latency_ms), 6) AS latency_ms_avg, count(*) FILTER (WHERE status_code IS NULL) AS timeouts,
          count(*) FILTER (WHERE status_code >= 400) AS http_errors,
          count(*) FILTER (WHERE status_code < 400 AND status_code <> 200) AS network_errors,
          {_tail(0.95, "prediction_log")} AS latency_ms_p95, {_tail(0.99, "prediction_log")} AS latency_ms_p99
        FROM prediction_log""",
)
def d36(spark, sf):
    return rounded(mo.request_summary(log(spark, sf)))


@query(
    "c11_labelled_predictions",
    """SELECT event_id, predicted_label, actual_label FROM prediction_log WHERE actual_label IN (0, 1)""",
)
def c11(spark, sf):
    rows = log(spark, sf)
    outcomes = rows.select("event_id", "actual_label")
    found = mo.labelled_predictions(rows, outcomes)
    return found.select("event_id", "predicted_label", "actual_label")


@query(
    "b21_numeric_coercion",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS word
       FROM events""",
)
def b21(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("word")
    )
    return mo.numeric(rows, ["k", "word"])


@query(
    "a10_prediction_log_scan",
    """SELECT latency_ms, confidence, score, predicted_label, actual_label, detection_delay_minutes,
         estimated_business_impact_usd, status_code, cpu_percent, memory_percent FROM prediction_log""",
)
def a10(spark, sf):
    from pipewatch.sources.readers import read_prediction_log

    path = scratch_path(spark, "typed-log")
    columns = schemas.columns(schemas.PREDICTION_LOG)
    lines = log(spark, sf).select(F.to_json(F.struct(*columns)).alias("value"))
    # A blank line after every record, as hand-edited logs have.
    lines.select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(path)
    return read_prediction_log(spark, path)


# --- alert rules, batch form of the streaming ones ---------------------------------------


def _bins(size: int) -> str:
    """Start of the tumbling window of ``size`` minutes."""
    return f"time_bucket(INTERVAL {size} MINUTE, ts)"


@query(
    "i7_service_windows",
    f"""SELECT {_bins(15)} AS window_start, {_bins(15)} + INTERVAL 15 MINUTE AS window_end, count(*) AS requests,
          round(avg(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END), 6) AS error_rate_5xx,
          round(avg(CASE WHEN coalesce(status_code, 500) < 500 THEN 1 ELSE 0 END), 6) AS availability
        FROM prediction_log GROUP BY 1, 2""",
)
def i7(spark, sf):
    return rounded(al.service_windows(log(spark, sf)))


CTES["short_windows"] = """
    SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, avg(latency_ms) AS duration,
      CAST(count(*) FILTER (WHERE coalesce(status_code, 500) >= 500) AS DOUBLE) AS failed
    FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS w FROM prediction_log, range(5) t(k))
    GROUP BY 1, 2"""
CTES["long_windows"] = """
    SELECT w AS window_start, w + INTERVAL 15 MINUTE AS window_end,
      avg(CASE WHEN coalesce(status_code, 500) < 500 THEN 1 ELSE 0 END) AS availability
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS w FROM prediction_log, range(3) t(k))
    GROUP BY 1, 2"""


@query(
    "i8_sliding_alerts",
    """SELECT 'latency' AS alert, window_start, window_end, round(duration, 6) AS value FROM short_windows WHERE duration > 150
       UNION ALL SELECT 'failed_requests', window_start, window_end, round(failed, 6) FROM short_windows WHERE failed > 0
       UNION ALL SELECT 'availability', window_start, window_end, round(availability, 6) FROM long_windows
         WHERE availability < 0.995""",
)
def i8(spark, sf):
    return rounded(al.sliding_alerts(log(spark, sf), max_duration_ms=150.0, max_failed=0))


CTES["hourly"] = """
    SELECT t.*, p95_latency_ms, p99_latency_ms FROM (
      SELECT date_trunc('hour', ts) AS period_start, avg(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) AS error_rate_5xx,
        avg(CASE WHEN coalesce(status_code, 500) < 500 THEN 1 ELSE 0 END) AS availability,
        avg(cpu_percent) AS cpu_percent, avg(memory_percent) AS memory_percent FROM prediction_log GROUP BY 1) t
    JOIN (SELECT period_start, max(CASE WHEN r = floor(0.95 * (n - 1)) THEN latency_ms END) AS p95_latency_ms,
        max(CASE WHEN r = floor(0.99 * (n - 1)) THEN latency_ms END) AS p99_latency_ms
      FROM (SELECT date_trunc('hour', ts) AS period_start, latency_ms,
          row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY latency_ms) - 1 AS r,
          count(*) OVER (PARTITION BY date_trunc('hour', ts)) AS n FROM prediction_log) GROUP BY 1) q
    ON q.period_start = t.period_start"""


@query(
    "i9_period_metrics",
    f"""SELECT period_start, {r6(['error_rate_5xx', 'availability', 'cpu_percent', 'memory_percent',
          'p95_latency_ms', 'p99_latency_ms'])} FROM hourly""",
)
def i9_periods(spark, sf):
    return rounded(al.period_metrics(log(spark, sf), "hour"))


def runs_sql(source: str, rules, names=("rule", "severity"), step: int = 3600) -> str:
    checks = " UNION ALL ".join(
        f"""SELECT period_start, '{rule}' AS {names[0]}, '{kind}' AS {names[1]}, {least} AS least FROM {source}
            WHERE {metric} {op} {limit}"""
        for rule, kind, metric, op, limit, least in rules
    )
    a, b = names
    return f"""SELECT {a}, {b}, min(period_start) AS breach_start, max(period_start) AS breach_last,
        count(*) AS periods FROM (SELECT *, CAST(epoch(period_start) / {step} AS BIGINT)
          - row_number() OVER (PARTITION BY {a} ORDER BY period_start) AS island FROM ({checks}))
      GROUP BY {a}, {b}, island HAVING count(*) >= max(least)"""


# The logged values are milder than a real outage, so the registered rules use lower limits.
HOURLY_RULES = [
    ("availability_low", "critical", "availability", "<", 0.99, 1),
    ("p95_latency_high", "warning", "p95_latency_ms", ">", 120.0, 3),
    ("p99_latency_high", "critical", "p99_latency_ms", ">", 200.0, 2),
    ("error_rate_high", "critical", "error_rate_5xx", ">", 0.02, 1),
    ("cpu_high", "warning", "cpu_percent", ">", 55.0, 2),
    ("memory_high", "warning", "memory_percent", ">", 50.0, 2),
]
HOURLY_SCALE_RULES = [
    ("scale_out_latency", "out", "p95_latency_ms", ">", 120.0, 3),
    ("scale_out_cpu", "out", "cpu_percent", ">", 55.0, 2),
]


@query("i9_sustained_breaches", runs_sql("hourly", HOURLY_RULES))
def i9(spark, sf):
    return al.sustained_breaches(al.period_metrics(log(spark, sf), "hour"), HOURLY_RULES, 3600)


@query(
    "i12_scale_recommendations",
    "SELECT * FROM ("
    + runs_sql("hourly", HOURLY_SCALE_RULES, ("rule", "direction"))
    + """) UNION ALL SELECT * FROM ("""
    + runs_sql(
        """(SELECT *, CASE WHEN p95_latency_ms < 200 AND cpu_percent < 50 THEN 1 ELSE 0 END AS quiet FROM hourly)""",
        [("scale_in_quiet", "in", "quiet", ">", 0.5, 2)],
        ("rule", "direction"),
    )
    + ")",
)
def i12(spark, sf):
    periods = al.period_metrics(log(spark, sf), "hour")
    return al.scale_recommendations(
        periods, 3600, HOURLY_SCALE_RULES, quiet_periods=2, quiet_p95=200.0, quiet_cpu=50.0
    )


CTES["weekly_rows"] = f"SELECT date_trunc('week', ts) AS week, {_OUTCOMES} FROM prediction_log GROUP BY 1"


@query(
    "i10_daily_drift",
    f"WITH {psi_sql(_LOG_LONG, 'day')} SELECT day, feature, round(psi, 6) AS psi FROM psi",
)
def i10_drift(spark, sf):
    return rounded(al.daily_drift(log(spark, sf), ["score", "confidence"]))


_TRIGGERS = f"""WITH {psi_sql(_LOG_LONG, 'day')},
  drift AS (SELECT 'drift' AS trigger, feature AS subject, count(*) AS periods FROM (
      SELECT feature, CAST(day - DATE '1970-01-01' AS BIGINT) - row_number() OVER (PARTITION BY feature ORDER BY day) AS i
      FROM psi WHERE psi > 0.2) GROUP BY feature, i HAVING count(*) >= 3),
  weeks AS (SELECT week, 'false_alarm_rate' AS metric FROM weekly_rows WHERE false_alarm_rate > 0.1
      UNION ALL SELECT week, 'missed_leak_rate' FROM weekly_rows WHERE missed_leak_rate > 0.05
      UNION ALL SELECT week, 'avg_detection_delay_minutes' FROM weekly_rows WHERE avg_detection_delay_minutes > 20),
  outcome AS (SELECT 'outcome' AS trigger, metric AS subject, count(*) AS periods FROM (
      SELECT metric, CAST(floor(epoch(week) / 604800) AS BIGINT) - row_number() OVER (PARTITION BY metric ORDER BY week) AS i
      FROM weeks) GROUP BY metric, i HAVING count(*) >= 2)
  SELECT trigger, subject, periods FROM drift UNION ALL SELECT trigger, subject, periods FROM outcome
  UNION ALL SELECT 'schema', 'added:region', CAST(1 AS BIGINT)
  UNION ALL SELECT 'schema', 'removed:legacy_flag', CAST(1 AS BIGINT)
  UNION ALL SELECT 'topology', 'removed', count(*) FROM (SELECT DISTINCT * FROM network_links
      EXCEPT SELECT * FROM network_links WHERE link_type <> 'R') HAVING count(*) > 0"""


@query("i10_retraining_triggers", _TRIGGERS)
def i10(spark, sf):
    rows = log(spark, sf)
    links = view(spark, sf, "network_links")
    return al.retraining_triggers(
        al.daily_drift(rows, ["score", "confidence"]),
        al.weekly_outcomes(rows),
        mo.schema_changes(*log_files(spark, sf)),
        al.topology_changes(links, links.filter("link_type <> 'R'")),
    )


@query(
    "i10_weekly_outcomes",
    f"SELECT week, {r6(_OUTCOME_NAMES)} FROM weekly_rows",
)
def i10_weekly(spark, sf):
    return rounded(al.weekly_outcomes(log(spark, sf)))


@query(
    "i11_impact_trend",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS avg_impact FROM orders GROUP BY 1),
       p AS (SELECT *, lag(avg_impact) OVER (ORDER BY month) AS previous_impact FROM m)
       SELECT month, round(avg_impact, 4) AS avg_impact, round(previous_impact, 4) AS previous_impact,
         round((avg_impact - previous_impact) / previous_impact, 4) AS change,
         coalesce((avg_impact - previous_impact) / previous_impact < -0.15, false) AS degraded FROM p""",
)
def i11(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("estimated_business_impact_usd")
    )
    return rounded(al.impact_trend(orders), 4)


@query(
    "i14_event_latency",
    """SELECT date_trunc('day', event_ts) AS window_start, date_trunc('day', event_ts) + INTERVAL 1 DAY AS window_end,
         count(*) AS events, round(avg(CASE WHEN (epoch_us(ts) - epoch_us(event_ts)) / 1e6 <= 60 THEN 1 ELSE 0 END), 6)
           AS usable_share, round(max((epoch_us(ts) - epoch_us(event_ts)) / 1e6), 6) AS max_delay_seconds
       FROM (SELECT ts, date_trunc('minute', ts - CAST(round(value) AS INTEGER) * INTERVAL 1 SECOND) AS event_ts FROM events)
       GROUP BY 1, 2""",
)
def i14(spark, sf):
    # A reading is stamped at the minute it was taken, some seconds before it arrived.
    rows = table(spark, sf, "events").selectExpr(
        "ts", "date_trunc('minute', timestampadd(SECOND, -CAST(round(value) AS INT), ts)) AS event_ts"
    )
    return rounded(al.event_latency(rows, "event_ts", "ts"))
