"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import rounded
from pipewatch.operators import quality as q
from pipewatch.operators.silver import event_time
from pipewatch.sources import readers as rd
from pipewatch.sources import schemas, writers
from pipewatch.sources.scratch import scratch_path
from pipewatch.sources.views import telemetry, view

CTES["timed_rows"] = """
    SELECT *, TRY_CAST(reading_time AS TIMESTAMP) AS event_ts FROM telemetry_raw"""
CTES["gap_rows"] = """
    SELECT *, CAST(epoch(date_trunc('second', event_ts)) - epoch(date_trunc('second',
        lag(event_ts) OVER (PARTITION BY node_id ORDER BY event_ts NULLS FIRST))) AS BIGINT) AS gap_seconds
    FROM timed_rows"""
CTES["duplicate_rows"] = """
    SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows FROM (
      SELECT count(*) AS n FROM telemetry_raw GROUP BY reading_time, node_id HAVING count(*) > 1)"""
CTES["metadata_rows"] = """
    SELECT count(*) AS row_count, count(*) FILTER (WHERE start_ts IS NULL OR end_ts IS NULL OR end_ts < start_ts)
      AS invalid_time_rows FROM leaks"""
CTES["orphan_rows"] = """
    SELECT * FROM network_links WHERE from_node NOT IN (SELECT node_id FROM network_nodes)
      OR to_node NOT IN (SELECT node_id FROM network_nodes)"""

NINE = schemas.columns(schemas.TELEMETRY)


def readings(spark, sf):
    """The nine columns of the telemetry contract."""
    return telemetry(spark, sf).select(*NINE)


def timed(spark, sf):
    return telemetry(spark, sf).withColumn("event_ts", event_time("timestamp"))


@query("d1_counts", "SELECT count(*) AS row_count, CAST(9 AS BIGINT) AS column_count FROM telemetry_raw")
def d1(spark, sf):
    return q.counts(readings(spark, sf))


@query(
    "d2_time_range",
    """SELECT min(event_ts) AS min_timestamp, max(event_ts) AS max_timestamp,
         count(*) FILTER (WHERE event_ts IS NULL) AS null_timestamp_rows FROM timed_rows""",
)
def d2(spark, sf):
    return q.time_range(readings(spark, sf), event_time("timestamp"))


@query("e1_sampling_gaps", "SELECT node_id, event_ts, gap_seconds FROM gap_rows")
def e1(spark, sf):
    return q.sampling_gaps(timed(spark, sf).select("node_id", "event_ts"), "node_id", "event_ts")


@query(
    "d3_sampling_interval",
    """SELECT min(gap_seconds) AS min_interval_seconds, round(avg(gap_seconds), 6) AS mean_interval_seconds,
         max(gap_seconds) AS max_interval_seconds FROM gap_rows WHERE gap_seconds > 0""",
)
def d3(spark, sf):
    return rounded(q.sampling_interval(timed(spark, sf), "node_id", "event_ts"))


@query(
    "d4_measure_alignment",
    """SELECT count(*) AS total_rows,
         count(*) FILTER (WHERE pressure IS NOT NULL AND flow IS NOT NULL AND demand IS NOT NULL) AS aligned_rows,
         round(count(*) FILTER (WHERE pressure IS NOT NULL AND flow IS NOT NULL AND demand IS NOT NULL)
               / count(*), 6) AS aligned_ratio FROM telemetry_raw""",
)
def d4(spark, sf):
    return rounded(q.alignment(readings(spark, sf)))


@query(
    "d5_label_distribution",
    "SELECT leak_label, count(*) AS readings FROM telemetry_raw GROUP BY 1",
)
def d5(spark, sf):
    return q.label_distribution(readings(spark, sf))


@query(
    "d5_label_domain",
    """SELECT count(*) FILTER (WHERE leak_label NOT IN (0, 1)) AS outside_domain,
         coalesce(bool_and(leak_label IN (0, 1)), true) AS ok FROM telemetry_raw""",
)
def d5_domain(spark, sf):
    label = F.col("leak_label")
    return readings(spark, sf).agg(
        q.bad_labels(label).alias("outside_domain"),
        F.coalesce(F.bool_and(label.isin(0, 1)), F.lit(True)).alias("ok"),
    )


@query(
    "d6_null_counts",
    "SELECT column_name, null_rows FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, count(*) FILTER (WHERE
        {'reading_time' if n == 'timestamp' else n} IS NULL) AS null_rows FROM telemetry_raw"""
        for n in NINE
    )
    + ")",
)
def d6(spark, sf):
    return q.null_counts(readings(spark, sf))


@query("d7_duplicate_groups", "SELECT duplicate_groups, excess_rows FROM duplicate_rows")
def d7(spark, sf):
    return q.duplicate_groups(readings(spark, sf), ["timestamp", "node_id"])


@query(
    "d8_outliers",
    """SELECT count(*) FILTER (WHERE pressure < 0 OR pressure > 200) AS pressure_outliers,
         count(*) FILTER (WHERE flow < 0 OR flow > 10000) AS flow_outliers,
         count(*) FILTER (WHERE demand < 0 OR demand > 10000) AS demand_outliers FROM telemetry_raw""",
)
def d8(spark, sf):
    return q.outliers(readings(spark, sf))


@query("d9_metadata_validity", "SELECT row_count, invalid_time_rows FROM metadata_rows")
def d9(spark, sf):
    return q.metadata_validity(view(spark, sf, "leak_metadata"))


@query("c3_orphan_links", "SELECT link_id, from_node, to_node, link_type FROM orphan_rows")
def c3(spark, sf):
    return q.orphan_links(view(spark, sf, "network_links"), view(spark, sf, "network_nodes"))


def _sql_report() -> str:
    def row(check: str, value: str, frm: str) -> str:
        return f"SELECT '{check}' AS \"check\", round(CAST({value} AS DOUBLE), 6) AS value FROM {frm}"

    t = "timed_rows"
    whole = "pressure IS NOT NULL AND flow IS NOT NULL AND demand IS NOT NULL"
    rows = [
        row("row_column_counts.row_count", "count(*)", t),
        row("row_column_counts.column_count", "max(9)", t),
        row("timestamps.min_epoch", "epoch(min(event_ts))", t),
        row("timestamps.max_epoch", "epoch(max(event_ts))", t),
        row("timestamps.null_timestamp_rows", "count(*) FILTER (WHERE event_ts IS NULL)", t),
        row("pressure_flow_demand_alignment.aligned_rows", f"count(*) FILTER (WHERE {whole})", t),
        row(
            "pressure_flow_demand_alignment.aligned_ratio",
            f"count(*) FILTER (WHERE {whole}) / count(*)",
            t,
        ),
        row("labels.outside_domain", "count(*) FILTER (WHERE leak_label NOT IN (0, 1))", t),
        row("labels.normal_rows", "count(*) FILTER (WHERE leak_label = 0)", t),
        row("labels.leak_rows", "count(*) FILTER (WHERE leak_label = 1)", t),
    ]
    for n in NINE:
        stored = "reading_time" if n == "timestamp" else n
        rows.append(row(f"missing_values.{n}", f"count(*) FILTER (WHERE {stored} IS NULL)", t))
    for m, (low, high) in q.RANGES.items():
        rows.append(
            row(
                f"invalid_or_outlier_sensor_values.{m}_outliers",
                f"count(*) FILTER (WHERE {m} < {low} OR {m} > {high})",
                t,
            )
        )
    for f in ("min", "mean", "max"):
        rows.append(
            row(
                f"sampling_interval_seconds.{f}_interval_seconds",
                f"{'avg' if f == 'mean' else f}(gap_seconds)",
                "gap_rows WHERE gap_seconds > 0",
            )
        )
    rows += [
        row("duplicates.duplicate_groups", "duplicate_groups", "duplicate_rows"),
        row("duplicates.excess_rows", "excess_rows", "duplicate_rows"),
        row("leak_metadata.row_count", "row_count", "metadata_rows"),
        row("leak_metadata.invalid_time_rows", "invalid_time_rows", "metadata_rows"),
        row("epanet_network_topology.orphan_link_rows", "count(*)", "orphan_rows"),
        row("leak_metadata.found", "max(1)", t),
        row("epanet_network_topology.found", "max(1)", t),
        row("file_inventory.entries", "max(5)", t),
        row("schemas.missing_columns", "max(3)", t),
    ]
    return " UNION ALL ".join(rows)


def landed(spark, sf):
    """A folder of the readings, a narrow second file without units, and the network files."""
    folder = scratch_path(spark, "landed")
    rows = readings(spark, sf)
    writers.write_csv(rows, f"{folder}/leakg3pd_sample.csv")
    writers.write_csv(rows.drop("pressure_unit", "flow_unit", "demand_unit"), f"{folder}/narrow.csv")
    for name, file in (("leak_metadata", "leak_metadata"), ("network_nodes", "net3_nodes"), ("network_links", "net3_links")):
        writers.write_csv(view(spark, sf, name), f"{folder}/{file}.csv")
    return folder


def report(spark, sf):
    folder = landed(spark, sf)
    return q.data_quality_report(
        readings(spark, sf),
        view(spark, sf, "leak_metadata"),
        view(spark, sf, "network_nodes"),
        view(spark, sf, "network_links"),
        headers=rd.file_headers(spark, folder),
        inventory=rd.file_inventory(spark, folder),
        expected_columns=NINE,
    )


@query("d10_quality_report", _sql_report())
def d10(spark, sf):
    return rounded(report(spark, sf))
