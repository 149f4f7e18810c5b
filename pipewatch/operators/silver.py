"""Curated readings: one unit system, aligned labels, no duplicates; the rest quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.operators.series import running_max

# Unit factors of the contract.
KPA_TO_PSI = 0.1450377377
LPS_TO_GPM = 15.8503231415

STANDARD = ("pressure_psi", "flow_gpm", "demand_gpm")
SENSOR = "sensor_node_id"
TIME = "event_ts_utc"


def event_time(text: Column | str) -> Column:
    """UTC instant of a time string, NULL when it is no time."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), "UTC")


def canonical(bronze: DataFrame) -> DataFrame:
    """Curated names and types; rows with a bad timestamp are still in."""
    return bronze.select(
        event_time(F.col("timestamp")).alias(TIME),
        F.col("node_id").alias(SENSOR),
        *[F.col(c).cast("double").alias(c) for c in ("pressure", "flow", "demand")],
        "pressure_unit",
        "flow_unit",
        "demand_unit",
        F.col("leak_label").cast("int").alias("leak_label"),
        "_ingest_ts",
        "_source_file",
        "_source_type",
        "_row_hash",
    )


def converted(value: str, unit: str, from_unit: str, factor: float) -> Column:
    return F.when(F.lower(unit) == from_unit, F.col(value) * F.lit(factor)).otherwise(F.col(value))


def standardize_units(df: DataFrame) -> DataFrame:
    """psi and gpm twins of the measures; unknown or missing units pass through."""
    return df.withColumns(
        {
            "pressure_psi": converted("pressure", "pressure_unit", "kpa", KPA_TO_PSI),
            "flow_gpm": converted("flow", "flow_unit", "lps", LPS_TO_GPM),
            "demand_gpm": converted("demand", "demand_unit", "lps", LPS_TO_GPM),
        }
    )


def known_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id").dropna().distinct()


def flag_unknown_sensors(df: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """invalid_sensor_id: the sensor is not in the network model."""
    if nodes is None:
        return df.withColumn("invalid_sensor_id", F.lit(False))
    known = known_nodes(nodes).select(F.col("node_id").alias("_known"))
    joined = df.join(known, df[SENSOR] == known["_known"], "left")
    return joined.withColumn("invalid_sensor_id", F.col("_known").isNull()).drop("_known")


def align_labels(df: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """leak_label_aligned: 1 inside any leak interval of the sensor, else the own label.

    An interval covers time t when the latest end among intervals started by t
    is not before t. So interval starts are merged into the sensor's time order
    and one running maximum of ends answers every reading; readings are never
    paired with intervals, however many a sensor has.
    """
    own = F.col("leak_label")
    if metadata is None:
        return df.withColumn("leak_label_aligned", own)
    starts = metadata.select(
        F.col("node_id").alias(SENSOR),
        event_time("start_time").alias(TIME),
        event_time("end_time").alias("_end"),
    ).filter(
        F.col("incident_id").isNotNull()
        & F.col(SENSOR).isNotNull()
        & F.col(TIME).isNotNull()
        & (F.col("_end") >= F.col(TIME))
    )
    readings = df.withColumns({"_end": F.lit(None).cast("timestamp"), "_reading": F.lit(True)})
    marked = readings.unionByName(
        starts.withColumn("_reading", F.lit(False)), allowMissingColumns=True
    )
    order = [F.col(TIME).asc(), F.col("_reading").asc()]
    swept = running_max(marked, SENSOR, order, "_end", "_open_until")
    covered = F.col("_open_until") >= F.col(TIME)
    return (
        swept.filter("_reading")
        .withColumn("leak_label_aligned", F.when(covered, F.lit(1)).otherwise(own))
        .drop("_end", "_reading", "_open_until")
    )


def aligned_measures() -> Column:
    return F.col("pressure_psi").isNotNull() & F.col("flow_gpm").isNotNull() & F.col("demand_gpm").isNotNull()


def quarantine_reason() -> Column:
    """First failing rule, NULL for a good row."""
    return (
        F.when(F.col(TIME).isNull(), "invalid_timestamp")
        .when(F.col(SENSOR).isNull(), "missing_sensor_node_id")
        .when(F.col("invalid_sensor_id"), "sensor_not_in_network_model")
        .when(F.col("pressure_psi") < 0, "negative_pressure")
        .when(F.col("flow_gpm") < 0, "negative_flow")
        .when(F.col("demand_gpm") < 0, "negative_demand")
        .when(~aligned_measures(), "telemetry_alignment_failure")
    )


def quarantine(curated: DataFrame) -> DataFrame:
    return curated.withColumn("quarantine_reason", quarantine_reason()).filter(
        F.col("quarantine_reason").isNotNull()
    )


def null_negatives(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in STANDARD})


def complete(df: DataFrame) -> DataFrame:
    """Rows with time, a known sensor and all three non-negative measures."""
    return (
        null_negatives(df)
        .dropna(subset=[TIME, SENSOR, *STANDARD])
        .filter(~F.col("invalid_sensor_id"))
    )


def deduplicate(df: DataFrame) -> DataFrame:
    """One row per (time, sensor): real before synthetic, then earliest ingest.

    Spark prunes every group to its first row before the shuffle, so copies of
    one reading do not pile up in a task.
    """
    order = [
        F.when(F.col("_source_type") == "real", 0).otherwise(1).asc(),
        F.col("_ingest_ts").asc(),
        F.col("_row_hash").asc(),
        F.col("pressure_unit").asc(),
        F.col("flow_unit").asc(),
        F.col("demand_unit").asc(),
    ]
    first = Window.partitionBy(TIME, SENSOR).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1").drop("_copy")


def tag_units(df: DataFrame) -> DataFrame:
    """Standard-unit columns, and the aligned label as the label."""
    return (
        df.withColumns(
            {
                "pressure_unit_standard": F.lit("psi"),
                "flow_unit_standard": F.lit("gpm"),
                "demand_unit_standard": F.lit("gpm"),
                "leak_label": F.col("leak_label_aligned").cast("int"),
            }
        )
        .drop("leak_label_aligned", "invalid_sensor_id")
    )


def curate(bronze: DataFrame, nodes: DataFrame | None) -> DataFrame:
    return flag_unknown_sensors(standardize_units(canonical(bronze)), nodes)


def silver(bronze: DataFrame, nodes: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """Clean readings. Labels depend on (sensor, time) only, so copies are dropped first."""
    clean = deduplicate(complete(curate(bronze, nodes)))
    return tag_units(align_labels(clean, metadata))


def quarantined(
    bronze: DataFrame,
    nodes: DataFrame | None = None,
    metadata: DataFrame | None = None,
    keep_bad_times: bool = True,
) -> DataFrame:
    """Rejected rows with their reason.

    Rows without a readable time are kept with reason ``invalid_timestamp``;
    ``keep_bad_times=False`` drops them, as a filter ahead of the rules would.
    """
    rejected = quarantine(curate(bronze, nodes))
    if not keep_bad_times:
        rejected = rejected.filter(F.col(TIME).isNotNull())
    return align_labels(rejected, metadata)
