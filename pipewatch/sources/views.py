"""Adapters: the driver's tables seen as telemetry, network, incident and log tables.

Each view is one SELECT over stored columns, written so that Spark and the
checking engine read the same text; only the draw ``{u:seed:id}`` differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # One raw reading per event, with the unit mix and dirt of a real feed.
    "telemetry_raw": """
        SELECT event_id,
          CASE WHEN event_id % 97 = 0 THEN 'not-a-time'
               ELSE substr(CAST(date_trunc('hour', ts) AS STRING), 1, 19) END AS reading_time,
          concat('N', user_id) AS node_id,
          CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 41 = 0 THEN -value ELSE value END AS pressure,
          CASE WHEN event_id % 43 = 0 THEN -value ELSE value * 2 END AS flow,
          CASE WHEN event_id % 53 = 0 THEN NULL ELSE value * 1.5 END AS demand,
          CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS leak_label,
          CASE WHEN event_id % 5 = 0 THEN 'kPa' WHEN event_id % 5 = 1 THEN NULL ELSE 'psi' END AS pressure_unit,
          CASE WHEN event_id % 7 = 0 THEN 'LPS' ELSE 'gpm' END AS flow_unit,
          CASE WHEN event_id % 11 = 0 THEN 'lps' ELSE 'gpm' END AS demand_unit,
          ts AS ingest_ts,
          CASE WHEN event_id % 20 = 0 THEN '/landing/Raw_Synthetic/batch.csv'
               WHEN event_id % 20 = 10 THEN '/landing/raw/SYNTH_batch.csv'
               ELSE '/landing/raw/sensors.csv' END AS source_file
        FROM events""",
    "leak_metadata": """
        SELECT concat('I', event_id) AS incident_id, concat('N', user_id) AS node_id,
          CAST(ts AS STRING) AS start_time,
          CASE WHEN event_id % 10 = 0 THEN NULL
               WHEN event_id % 11 = 0 THEN CAST(ts - INTERVAL '1' HOUR AS STRING)
               ELSE CAST(ts + INTERVAL '12' HOUR AS STRING) END AS end_time,
          CASE WHEN value >= 100 THEN 'major' ELSE 'minor' END AS severity,
          least(value / 200, 1.0) AS confidence
        FROM events WHERE event_type = 'signup'""",
    # Accounts in debt are not metered, which leaves some readings on unknown sensors.
    "network_nodes": """
        SELECT concat('N', c_custkey) AS node_id, c_mktsegment AS node_type
        FROM customer WHERE c_acctbal >= 0""",
    "network_links": """
        SELECT concat('L', l_orderkey, '-', l_linenumber) AS link_id,
          concat('N', l_suppkey) AS from_node, concat('N', l_partkey) AS to_node,
          l_returnflag AS link_type
        FROM lineitem""",
    "prediction_log": """
        SELECT event_id, ts, value AS latency_ms,
          least(value / 400, 1.0) AS score, least(0.99, 0.5 + value / 1000) AS confidence,
          CASE WHEN value >= 40 THEN 1 ELSE 0 END AS predicted_label,
          CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'click' THEN 0 END AS actual_label,
          CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 10 END AS detection_delay_minutes,
          CASE WHEN event_id % 6 = 0 THEN NULL ELSE value * 10 END AS estimated_business_impact_usd,
          CASE WHEN event_id % 200 = 0 THEN 500 WHEN event_id % 150 = 1 THEN 404
               WHEN event_id % 300 = 7 THEN NULL ELSE 200 END AS status_code,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS cpu_percent,
          CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) END AS memory_percent,
          CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'baseline' ELSE 'current' END AS side
        FROM events""",
    # Ground truth y with a noisy score that leans towards it.
    "scored": """
        SELECT event_id, ts, concat('N', user_id) AS sensor_node_id,
          CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
          round(0.65 * {u:42:event_id}
                + CASE WHEN event_type = 'error' THEN 0.35 ELSE 0.0 END, 4) AS score,
          CASE WHEN event_id % 10 = 0 THEN 'synthetic' ELSE 'real' END AS _source_type
        FROM events""",
    # Three models' scores of the same rows, from sharp to blunt.
    "model_scores": """
        SELECT event_id, ts, 'isolation_forest' AS model, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
          round(0.6 * {u:7:event_id} + CASE WHEN event_type = 'error' THEN 0.4 ELSE 0.0 END, 4) AS score FROM events
        UNION ALL SELECT event_id, ts, 'random_forest', CASE WHEN event_type = 'error' THEN 1 ELSE 0 END,
          round(0.8 * {u:8:event_id} + CASE WHEN event_type = 'error' THEN 0.2 ELSE 0.0 END, 4) FROM events
        UNION ALL SELECT event_id, ts, 'xgboost', CASE WHEN event_type = 'error' THEN 1 ELSE 0 END,
          round(0.7 * {u:9:event_id} + CASE WHEN event_type = 'error' THEN 0.3 ELSE 0.0 END, 4) FROM events""",
    "incident_request": """
        SELECT concat('N', l_orderkey) AS incident_id,
          max(l_discount) * 10 AS leak_probability,
          CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10 AS anomaly_score,
          avg(l_quantity) / 50 AS forecast_stress_index, count(*) AS telemetry_points
        FROM lineitem GROUP BY l_orderkey""",
    "incident_telemetry": """
        SELECT concat('N', l_orderkey) AS incident_id, concat('A', l_partkey) AS asset_id,
          concat('N', l_suppkey) AS node_id, l_shipdate AS reading_time,
          l_quantity * 2 AS pressure, l_extendedprice / 100 AS flow, l_tax * 100 AS demand
        FROM lineitem""",
    "approval": """
        SELECT concat('N', o_custkey) AS incident_id, o_orderpriority AS approver_id,
          o_orderstatus = 'F' AS approve, o_orderdate AS approved_at, o_orderkey AS seq
        FROM orders""",
}


def _draws(sql: str, engine: str) -> str:
    def one(match: re.Match) -> str:
        seed, ident = match.group(1), match.group(2)
        digest = f"substr(md5(concat('{seed}', ':', {ident})), 1, 8)"
        if engine == "spark":
            return f"(CAST(conv({digest}, 16, 10) AS DOUBLE) / 4294967296.0D)"
        return f"(CAST(CAST(concat('0x', {digest}) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"

    return re.sub(r"\{u:([^:}]+):([^}]+)\}", one, sql)


def spark_sql_text(sql: str) -> str:
    # Decimal literals must be doubles, as they are in the checking engine's text below.
    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'D])", r"\1D", sql)
    return _draws(sql, "spark")


def duckdb_text(sql: str) -> str:
    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.':])", r"\1::DOUBLE", sql)
    return _draws(sql, "duckdb")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the parquet tables in ``sf_dir``."""
    sql = spark_sql_text(VIEWS[name])
    base = re.findall(r"\bFROM\s+(\w+)", sql)
    for b in set(base):
        sql = re.sub(rf"\bFROM\s+{b}\b", f"FROM {{{b}}}", sql)
    return spark.sql(sql, **{b: table(spark, sf_dir, b) for b in set(base)})


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings under the column names of the telemetry contract."""
    return view(spark, sf_dir, "telemetry_raw").withColumnRenamed("reading_time", "timestamp")
