"""Sources, projections, joins and series features of the bronze-silver-gold chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import rounded
from pipewatch.operators import bronze as bz
from pipewatch.operators import gold as gd
from pipewatch.operators import silver as sv
from pipewatch.sources.views import telemetry, view

CTES["bronze_rows"] = """
    SELECT *,
      CASE WHEN contains(lower(source_file), '/raw_synthetic/') THEN 'synthetic'
           WHEN contains(lower(source_file), 'synth_') THEN 'synthetic' ELSE 'real' END AS source_type,
      sha256(concat_ws('||', reading_time, node_id, CAST(pressure AS VARCHAR), CAST(flow AS VARCHAR),
             CAST(demand AS VARCHAR), CAST(leak_label AS VARCHAR))) AS row_hash
    FROM telemetry_raw"""
CTES["leaks"] = """
    SELECT *, TRY_CAST(start_time AS TIMESTAMP) AS start_ts, TRY_CAST(end_time AS TIMESTAMP) AS end_ts
    FROM leak_metadata"""
CTES["curated_rows"] = """
    SELECT TRY_CAST(b.reading_time AS TIMESTAMP) AS event_ts_utc, b.node_id AS sensor_node_id,
      pressure, flow, demand, pressure_unit, flow_unit, demand_unit, leak_label,
      ingest_ts, source_file, source_type, row_hash,
      CASE WHEN lower(pressure_unit) = 'kpa' THEN pressure * 0.1450377377 ELSE pressure END AS pressure_psi,
      CASE WHEN lower(flow_unit) = 'lps' THEN flow * 15.8503231415 ELSE flow END AS flow_gpm,
      CASE WHEN lower(demand_unit) = 'lps' THEN demand * 15.8503231415 ELSE demand END AS demand_gpm,
      NOT EXISTS (SELECT 1 FROM network_nodes n WHERE n.node_id = b.node_id) AS invalid_sensor_id,
      CASE WHEN EXISTS (SELECT 1 FROM leaks l WHERE l.node_id = b.node_id
             AND TRY_CAST(b.reading_time AS TIMESTAMP) BETWEEN l.start_ts AND l.end_ts)
           THEN 1 ELSE leak_label END AS leak_label_aligned
    FROM bronze_rows b"""
CTES["quarantine_rows"] = """
    SELECT * FROM (
      SELECT *, CASE WHEN event_ts_utc IS NULL THEN 'invalid_timestamp'
        WHEN sensor_node_id IS NULL THEN 'missing_sensor_node_id'
        WHEN invalid_sensor_id THEN 'sensor_not_in_network_model'
        WHEN pressure_psi < 0 THEN 'negative_pressure'
        WHEN flow_gpm < 0 THEN 'negative_flow'
        WHEN demand_gpm < 0 THEN 'negative_demand'
        WHEN pressure_psi IS NULL OR flow_gpm IS NULL OR demand_gpm IS NULL
          THEN 'telemetry_alignment_failure' END AS quarantine_reason
      FROM curated_rows) WHERE quarantine_reason IS NOT NULL"""
CTES["complete_rows"] = """
    SELECT * FROM curated_rows
    WHERE event_ts_utc IS NOT NULL AND sensor_node_id IS NOT NULL AND NOT invalid_sensor_id
      AND pressure_psi >= 0 AND flow_gpm >= 0 AND demand_gpm >= 0"""
CTES["silver_rows"] = """
    SELECT * EXCLUDE (copy, leak_label, leak_label_aligned, invalid_sensor_id),
      leak_label_aligned AS leak_label
    FROM (SELECT *, row_number() OVER (PARTITION BY event_ts_utc, sensor_node_id
            ORDER BY CASE WHEN source_type = 'real' THEN 0 ELSE 1 END, ingest_ts, row_hash,
              pressure_unit NULLS FIRST, flow_unit NULLS FIRST, demand_unit NULLS FIRST) AS copy
          FROM complete_rows) WHERE copy = 1"""
CTES["degree_rows"] = """
    SELECT sensor_node_id, CAST(sum(n) AS BIGINT) AS node_degree FROM (
      SELECT from_node AS sensor_node_id, count(*) AS n FROM network_links GROUP BY 1
      UNION ALL SELECT to_node, count(*) FROM network_links GROUP BY 1) GROUP BY 1"""
CTES["series_rows"] = """
    SELECT *, pressure_psi - pressure_lag_1 AS pressure_delta, flow_gpm - flow_lag_1 AS flow_delta,
      demand_gpm - demand_lag_1 AS demand_delta,
      CASE WHEN pressure_lag_1 <> 0 THEN (pressure_psi - pressure_lag_1) / pressure_lag_1 ELSE 0 END AS pressure_roc,
      CASE WHEN flow_lag_1 <> 0 THEN (flow_gpm - flow_lag_1) / flow_lag_1 ELSE 0 END AS flow_roc,
      CASE WHEN demand_lag_1 <> 0 THEN (demand_gpm - demand_lag_1) / demand_lag_1 ELSE 0 END AS demand_roc
    FROM (SELECT *,
        lag(pressure_psi, 1) OVER w AS pressure_lag_1, lag(pressure_psi, 2) OVER w AS pressure_lag_2,
        lag(flow_gpm, 1) OVER w AS flow_lag_1, lag(demand_gpm, 1) OVER w AS demand_lag_1,
        avg(pressure_psi) OVER w3 AS pressure_roll_avg_3, avg(pressure_psi) OVER w6 AS pressure_roll_avg_6,
        avg(flow_gpm) OVER w3 AS flow_roll_avg_3, avg(flow_gpm) OVER w6 AS flow_roll_avg_6,
        avg(demand_gpm) OVER w3 AS demand_roll_avg_3, avg(demand_gpm) OVER w6 AS demand_roll_avg_6,
        lead(leak_label, 1) OVER w AS target_raw, lead(leak_label, 3) OVER w AS target_raw_3
      FROM silver_rows
      WINDOW w AS (PARTITION BY sensor_node_id ORDER BY event_ts_utc),
        w3 AS (PARTITION BY sensor_node_id ORDER BY event_ts_utc ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        w6 AS (PARTITION BY sensor_node_id ORDER BY event_ts_utc ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
_FILLED = [
    "pressure_psi", "flow_gpm", "demand_gpm",
    "pressure_lag_1", "pressure_lag_2", "flow_lag_1", "demand_lag_1",
    "pressure_delta", "flow_delta", "demand_delta", "pressure_roc", "flow_roc", "demand_roc",
    "pressure_roll_avg_3", "pressure_roll_avg_6", "flow_roll_avg_3", "flow_roll_avg_6",
    "demand_roll_avg_3", "demand_roll_avg_6",
]
CTES["gold_rows"] = f"""
    SELECT s.event_ts_utc, s.sensor_node_id, s.leak_label, s.source_type, s.row_hash,
      coalesce(pressure, 0) AS pressure, coalesce(flow, 0) AS flow, coalesce(demand, 0) AS demand,
      {", ".join(f"coalesce({c}, 0) AS {c}" for c in _FILLED)},
      CAST(hour(event_ts_utc) AS INTEGER) AS hour_of_day,
      CAST(dayofweek(event_ts_utc) + 1 AS INTEGER) AS day_of_week,
      CASE WHEN dayofweek(event_ts_utc) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
      coalesce(d.node_degree, 0) AS node_degree,
      coalesce(target_raw, leak_label) AS target_leak_horizon
    FROM series_rows s LEFT JOIN degree_rows d ON d.sensor_node_id = s.sensor_node_id"""


# --- frames the queries share -------------------------------------------------


def bronze_frame(spark: SparkSession, sf: str) -> DataFrame:
    raw = telemetry(spark, sf)
    made = bz.bronze(raw, F.col("source_file"), F.col("ingest_ts"))
    return made.drop("source_file", "ingest_ts")


def silver_frame(spark: SparkSession, sf: str) -> DataFrame:
    return sv.silver(
        bronze_frame(spark, sf), view(spark, sf, "network_nodes"), view(spark, sf, "leak_metadata")
    )


def gold_frame(spark: SparkSession, sf: str) -> DataFrame:
    return gd.gold(silver_frame(spark, sf), view(spark, sf, "network_links"))


def curated_frame(spark: SparkSession, sf: str) -> DataFrame:
    return sv.curate(bronze_frame(spark, sf), view(spark, sf, "network_nodes"))


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- B: projections and filters ----------------------------------------------


@query(
    "b1_ingest_lineage",
    """SELECT event_id, source_file AS _source_file, ingest_ts AS _ingest_ts, 'bronze_ingest' AS _ingest_job,
         'v1' AS _schema_version, source_type AS _source_type FROM bronze_rows""",
)
def b1(spark, sf):
    return bronze_frame(spark, sf).select(
        "event_id", "_source_file", "_ingest_ts", "_ingest_job", "_schema_version", "_source_type"
    )


@query("b2_source_type", "SELECT source_type, count(*) AS readings FROM bronze_rows GROUP BY 1")
def b2(spark, sf):
    return (
        bronze_frame(spark, sf)
        .groupBy(F.col("_source_type").alias("source_type"))
        .agg(F.count(F.lit(1)).alias("readings"))
    )


@query("b3_row_hash", "SELECT event_id, row_hash FROM bronze_rows")
def b3(spark, sf):
    return bronze_frame(spark, sf).select("event_id", F.col("_row_hash").alias("row_hash"))


@query(
    "b4_event_time",
    """SELECT event_id, TRY_CAST(reading_time AS TIMESTAMP) AS event_ts_utc FROM telemetry_raw
       WHERE TRY_CAST(reading_time AS TIMESTAMP) IS NOT NULL""",
)
def b4(spark, sf):
    raw = telemetry(spark, sf)
    return raw.select("event_id", sv.event_time("timestamp").alias(sv.TIME)).dropna(subset=[sv.TIME])


@query(
    "b5_canonical_projection",
    """SELECT event_ts_utc, sensor_node_id, pressure, flow, demand, pressure_unit, flow_unit, demand_unit,
         leak_label, ingest_ts AS _ingest_ts, source_file AS _source_file, source_type AS _source_type,
         row_hash AS _row_hash FROM curated_rows""",
)
def b5(spark, sf):
    return sv.canonical(bronze_frame(spark, sf))


@query("b6_pressure_to_psi", f"SELECT row_hash, pressure_unit, {r6('pressure_psi')} FROM curated_rows")
def b6(spark, sf):
    std = sv.standardize_units(sv.canonical(bronze_frame(spark, sf)))
    return rounded(std.select(F.col("_row_hash").alias("row_hash"), "pressure_unit", "pressure_psi"))


@query("b7_flow_demand_to_gpm", f"SELECT row_hash, {r6('flow_gpm', 'demand_gpm')} FROM curated_rows")
def b7(spark, sf):
    std = sv.standardize_units(sv.canonical(bronze_frame(spark, sf)))
    return rounded(std.select(F.col("_row_hash").alias("row_hash"), "flow_gpm", "demand_gpm"))


@query(
    "b8_negatives_to_null",
    """SELECT row_hash, CASE WHEN pressure_psi >= 0 THEN round(pressure_psi, 6) END AS pressure_psi,
         CASE WHEN flow_gpm >= 0 THEN round(flow_gpm, 6) END AS flow_gpm,
         CASE WHEN demand_gpm >= 0 THEN round(demand_gpm, 6) END AS demand_gpm FROM curated_rows""",
)
def b8(spark, sf):
    std = sv.null_negatives(sv.standardize_units(sv.canonical(bronze_frame(spark, sf))))
    return rounded(std.select(F.col("_row_hash").alias("row_hash"), *sv.STANDARD))


@query(
    "b9_complete_rows",
    f"""SELECT event_ts_utc, sensor_node_id, row_hash, {r6('pressure_psi', 'flow_gpm', 'demand_gpm')}
        FROM complete_rows""",
)
def b9(spark, sf):
    done = sv.complete(curated_frame(spark, sf))
    return rounded(
        done.select(sv.TIME, sv.SENSOR, F.col("_row_hash").alias("row_hash"), *sv.STANDARD)
    )


@query(
    "b10_quarantine",
    """SELECT event_ts_utc, sensor_node_id, row_hash, invalid_sensor_id, leak_label_aligned,
         quarantine_reason FROM quarantine_rows""",
)
def b10(spark, sf):
    out = sv.quarantined(
        bronze_frame(spark, sf), view(spark, sf, "network_nodes"), view(spark, sf, "leak_metadata")
    )
    return out.select(
        sv.TIME, sv.SENSOR, F.col("_row_hash").alias("row_hash"), "invalid_sensor_id",
        "leak_label_aligned", "quarantine_reason",
    )


@query(
    "b10_quarantine_reasons",
    "SELECT quarantine_reason, count(*) AS readings FROM quarantine_rows GROUP BY 1",
)
def b10_reasons(spark, sf):
    rejected = sv.quarantine(curated_frame(spark, sf))
    return rejected.groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("readings"))


@query(
    "b11_unit_tags",
    """SELECT event_ts_utc, sensor_node_id, 'psi' AS pressure_unit_standard, 'gpm' AS flow_unit_standard,
         'gpm' AS demand_unit_standard, leak_label FROM silver_rows""",
)
def b11(spark, sf):
    return silver_frame(spark, sf).select(
        sv.TIME, sv.SENSOR, "pressure_unit_standard", "flow_unit_standard",
        "demand_unit_standard", "leak_label",
    )


@query(
    "b12_calendar",
    """SELECT event_ts_utc, sensor_node_id, hour_of_day, day_of_week, is_weekend FROM gold_rows""",
)
def b12(spark, sf):
    s = silver_frame(spark, sf).withColumns(gd.calendar())
    return s.select(sv.TIME, sv.SENSOR, "hour_of_day", "day_of_week", "is_weekend")


@query(
    "b13_null_policy",
    f"""SELECT event_ts_utc, sensor_node_id, source_type, node_degree, target_leak_horizon,
          {r6('pressure_lag_1', 'pressure_lag_2', 'flow_lag_1', 'demand_lag_1', 'pressure_delta')}
        FROM gold_rows""",
)
def b13(spark, sf):
    return rounded(
        gold_frame(spark, sf).select(
            sv.TIME, sv.SENSOR, F.col("_source_type").alias("source_type"), "node_degree",
            "target_leak_horizon", "pressure_lag_1", "pressure_lag_2", "flow_lag_1", "demand_lag_1",
            "pressure_delta",
        )
    )


# --- C: joins -------------------------------------------------------------------


@query(
    "c1_align_labels",
    """SELECT event_ts_utc, sensor_node_id, row_hash, leak_label, leak_label_aligned FROM curated_rows
       WHERE event_ts_utc IS NOT NULL""",
)
def c1(spark, sf):
    canonical = sv.canonical(bronze_frame(spark, sf)).dropna(subset=[sv.TIME])
    aligned = sv.align_labels(canonical, view(spark, sf, "leak_metadata"))
    return aligned.select(
        sv.TIME, sv.SENSOR, F.col("_row_hash").alias("row_hash"), "leak_label", "leak_label_aligned"
    )


@query(
    "c2_network_membership",
    """SELECT sensor_node_id, invalid_sensor_id, count(*) AS readings FROM curated_rows GROUP BY 1, 2""",
)
def c2(spark, sf):
    flagged = sv.flag_unknown_sensors(
        sv.canonical(bronze_frame(spark, sf)), view(spark, sf, "network_nodes")
    )
    return flagged.groupBy(sv.SENSOR, "invalid_sensor_id").agg(F.count(F.lit(1)).alias("readings"))


@query(
    "c4_node_degree_join",
    "SELECT event_ts_utc, sensor_node_id, node_degree FROM gold_rows",
)
def c4(spark, sf):
    joined = gd.attach_degree(silver_frame(spark, sf), view(spark, sf, "network_links"))
    return joined.select(sv.TIME, sv.SENSOR, "node_degree")


# --- D11, E: series ---------------------------------------------------------------


@query("d11_node_degree", "SELECT sensor_node_id, node_degree FROM degree_rows")
def d11(spark, sf):
    return gd.node_degree(view(spark, sf, "network_links"))


@query(
    "e2_lags",
    f"""SELECT event_ts_utc, sensor_node_id,
          {r6('pressure_lag_1', 'pressure_lag_2', 'flow_lag_1', 'demand_lag_1')} FROM series_rows""",
)
def e2(spark, sf):
    s = gd.series_features(silver_frame(spark, sf))
    return rounded(
        s.select(sv.TIME, sv.SENSOR, "pressure_lag_1", "pressure_lag_2", "flow_lag_1", "demand_lag_1")
    )


_E3 = ["pressure_delta", "flow_delta", "demand_delta", "pressure_roc", "flow_roc", "demand_roc"]


@query("e3_changes", f"SELECT event_ts_utc, sensor_node_id, {r6(*_E3)} FROM series_rows")
def e3(spark, sf):
    s = gd.series_features(silver_frame(spark, sf))
    return rounded(s.select(sv.TIME, sv.SENSOR, *_E3))


_E4 = [f"{m}_roll_avg_{n}" for m in ("pressure", "flow", "demand") for n in (3, 6)]


@query("e4_rolling_means", f"SELECT event_ts_utc, sensor_node_id, {r6(*_E4)} FROM series_rows")
def e4(spark, sf):
    s = gd.series_features(silver_frame(spark, sf))
    return rounded(s.select(sv.TIME, sv.SENSOR, *_E4))


@query(
    "e5_horizon_target",
    """SELECT event_ts_utc, sensor_node_id, coalesce(target_raw_3, leak_label) AS target_leak_horizon
       FROM series_rows""",
)
def e5(spark, sf):
    s = gd.fill_gaps(
        gd.series_features(silver_frame(spark, sf), horizon=3)
    )
    return s.select(sv.TIME, sv.SENSOR, "target_leak_horizon")


@query(
    "e6_deduplicate",
    """SELECT event_ts_utc, sensor_node_id, source_type, row_hash FROM silver_rows""",
)
def e6(spark, sf):
    d = sv.deduplicate(sv.complete(curated_frame(spark, sf)))
    return d.select(
        sv.TIME, sv.SENSOR, F.col("_source_type").alias("source_type"),
        F.col("_row_hash").alias("row_hash"),
    )


# --- whole layers -------------------------------------------------------------------


@query(
    "silver_table",
    f"""SELECT event_ts_utc, sensor_node_id, leak_label, source_type AS _source_type, row_hash AS _row_hash,
          {r6('pressure', 'flow', 'demand', 'pressure_psi', 'flow_gpm', 'demand_gpm')} FROM silver_rows""",
)
def silver_table(spark, sf):
    return rounded(
        silver_frame(spark, sf).select(
            sv.TIME, sv.SENSOR, "leak_label", "_source_type", "_row_hash",
            "pressure", "flow", "demand", *sv.STANDARD,
        )
    )


_GOLD_OUT = [*_FILLED, "pressure", "flow", "demand"]


@query(
    "gold_table",
    f"""SELECT event_ts_utc, sensor_node_id, leak_label, source_type AS _source_type, row_hash AS _row_hash,
          hour_of_day, day_of_week, is_weekend, node_degree, target_leak_horizon, {r6(*_GOLD_OUT)}
        FROM gold_rows""",
)
def gold_table(spark, sf):
    return rounded(
        gold_frame(spark, sf).select(
            sv.TIME, sv.SENSOR, "leak_label", "_source_type", "_row_hash", "hour_of_day",
            "day_of_week", "is_weekend", "node_degree", "target_leak_horizon", *_GOLD_OUT,
        )
    )


# --- G: set operations ----------------------------------------------------------------


@query(
    "g1_degree_union",
    """SELECT sensor_node_id, side, count(*) AS link_ends FROM (
         SELECT from_node AS sensor_node_id, 'from' AS side FROM network_links
         UNION ALL SELECT to_node, 'to' FROM network_links) GROUP BY 1, 2""",
)
def g1(spark, sf):
    links = view(spark, sf, "network_links")
    sides = [
        links.groupBy(F.col(c).alias(sv.SENSOR), F.lit(side).alias("side")).agg(
            F.count(F.lit(1)).alias("link_ends")
        )
        for c, side in (("from_node", "from"), ("to_node", "to"))
    ]
    return sides[0].unionByName(sides[1])


@query("g4_distinct_nodes", "SELECT DISTINCT node_id FROM network_nodes WHERE node_id IS NOT NULL")
def g4(spark, sf):
    return sv.known_nodes(view(spark, sf, "network_nodes"))
