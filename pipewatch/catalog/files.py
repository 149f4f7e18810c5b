"""Source and sink queries: the tables are written out in the feed's formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog import metrics as mc
from pipewatch.catalog import quality as qc
from pipewatch.catalog.medallion import _GOLD_OUT, gold_frame, silver_frame
from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import rounded
from pipewatch.operators import bronze as bz
from pipewatch.operators import gold as gd
from pipewatch.operators import metrics as m
from pipewatch.sources import readers, schemas, writers
from pipewatch.sources.scratch import scratch_path
from pipewatch.sources.views import table, telemetry, view

NINE = qc.NINE
_NINE_SQL = ", ".join('reading_time AS "timestamp"' if n == "timestamp" else n for n in NINE)


def raw_folder(spark, sf):
    """A landing folder as the feed fills it: readings, incident and network files."""
    path = scratch_path(spark, "raw")
    # A sensor that cannot measure says so in words, which is no number.
    text = F.coalesce(F.col("pressure").cast("string"), F.lit("n/a"))
    readings = telemetry(spark, sf).select(*NINE).withColumn("pressure", text)
    writers.write_csv(readings, f"{path}/leakg3pd_sample.csv")
    writers.write_csv(view(spark, sf, "leak_metadata"), f"{path}/leak_metadata.csv")
    writers.write_csv(view(spark, sf, "network_nodes"), f"{path}/net3_nodes.csv")
    writers.write_csv(view(spark, sf, "network_links"), f"{path}/net3_links.csv")
    return path


@query("a1_telemetry_csv", f"SELECT {_NINE_SQL} FROM telemetry_raw")
def a1(spark, sf):
    return readers.read_telemetry(spark, f"{raw_folder(spark, sf)}/leakg3pd_sample.csv")


@query(
    "a2_real_and_synthetic",
    "SELECT source_type AS _source_type, count(*) AS readings, round(sum(flow), 4) AS flow FROM bronze_rows GROUP BY 1",
)
def a2(spark, sf):
    from pipewatch.catalog.medallion import bronze_frame

    path = scratch_path(spark, "two-feeds")
    rows = bronze_frame(spark, sf)
    for kind, folder in (("real", "raw"), ("synthetic", "raw_synthetic")):
        part = rows.filter(F.col("_source_type") == kind).select(*NINE)
        writers.write_csv(part, f"{path}/{folder}")
    both = readers.read_telemetry(spark, f"{path}/raw", f"{path}/raw_synthetic")
    lined = bz.bronze(both)
    out = lined.groupBy("_source_type").agg(
        F.count(F.lit(1)).alias("readings"), F.sum("flow").alias("flow")
    )
    return rounded(out, 4)


@query("a3_leak_metadata", "SELECT incident_id, node_id, severity, confidence, start_ts, end_ts FROM leaks")
def a3_metadata(spark, sf):
    from pipewatch.operators.silver import event_time

    found = readers.read_leak_metadata(spark, raw_folder(spark, sf))
    return found.select(
        "incident_id", "node_id", "severity", "confidence",
        event_time("start_time").alias("start_ts"), event_time("end_time").alias("end_ts"),
    )


@query("a3_network_nodes", "SELECT node_id, node_type FROM network_nodes")
def a3_nodes(spark, sf):
    return readers.read_nodes(spark, raw_folder(spark, sf))


@query("a3_network_links", "SELECT link_id, from_node, to_node, link_type FROM network_links")
def a3_links(spark, sf):
    return readers.read_links(spark, raw_folder(spark, sf))


@query(
    "a5_parquet_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00'",
)
def a5(spark, sf):
    rows = table(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "a6_overwrite_sink",
    "SELECT event_ts_utc, sensor_node_id, leak_label, row_hash AS _row_hash FROM silver_rows",
)
def a6(spark, sf):
    path = scratch_path(spark, "silver")
    rows = silver_frame(spark, sf)
    writers.write_table(rows.filter("leak_label = 1"), path)
    return writers.write_table(rows, path).select(
        "event_ts_utc", "sensor_node_id", "leak_label", "_row_hash"
    )


@query("a7_quality_document", qc._sql_report())
def a7(spark, sf):
    written = writers.write_document(rounded(qc.report(spark, sf)), scratch_path(spark, "report"))
    return written.select(F.from_json("value", "check string, value double").alias("d")).select("d.*")


@query(
    "a7_feature_dictionary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, '{text}' AS description, count({c}) AS stored_values FROM gold_rows"""
        for c, text in gd.FEATURE_DICTIONARY.items()
    ),
)
def a7_dictionary(spark, sf):
    """The dictionary as a document, beside what each stored feature holds."""
    gold = gold_frame(spark, sf)
    described = gd.feature_dictionary(gold).filter("description IS NOT NULL")
    written = writers.write_document(described, scratch_path(spark, "dictionary"))
    parsed = written.select(F.from_json("value", "name string, description string").alias("d"))
    stored = list(gd.FEATURE_DICTIONARY)
    counts = gold.agg(*[F.count(c).alias(c) for c in stored]).unpivot([], stored, "name", "stored_values")
    return parsed.select("d.*").join(counts, "name")


@query("a8_file_inventory")
def a8(spark, sf):
    return readers.file_inventory(spark, raw_folder(spark, sf))


@query(
    "a9_expected_files",
    "SELECT entry, true AS found FROM (VALUES "
    + ", ".join(f"('{f}')" for f in schemas.EXPECTED_FILES)
    + ") t(entry) WHERE EXISTS (SELECT 1 FROM telemetry_raw)",
)
def a9(spark, sf):
    return readers.inventory_check(readers.file_inventory(spark, raw_folder(spark, sf)))


@query(
    "a12_model_reports",
    """SELECT model, 0.5 AS threshold, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
         round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, tp + fn AS support
       FROM model_table""",
)
def a12(spark, sf):
    path = scratch_path(spark, "reports")
    lines = m.classification_report(m.confusion(view(spark, sf, "model_scores"), 0.5, ("model",)))
    scores = F.struct("precision", "recall", F.col("f1").alias("f1-score"), F.col("support").cast("double").alias("support"))

    def line(label):
        return F.max(F.when(F.col("label") == label, scores))

    split = F.struct(
        line("no_leak").alias("no_leak"), line("leak").alias("leak"), F.max("accuracy").alias("accuracy")
    )
    reports = lines.groupBy("model").agg(
        F.lit(0.5).alias("threshold"), split.alias("validation"), split.alias("test")
    )
    # One document per model, each in its own folder.
    pretty = F.to_json(F.struct("model", "threshold", "validation", "test"), {"pretty": "true"})
    reports.select(F.col("model").alias("name"), pretty.alias("value")).write.partitionBy("name").text(path)
    found = readers.read_classification_reports(spark, f"{path}/name=*")
    return rounded(found)


@query(
    "a13_delimited_landing",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice,
         CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""",
)
def a13(spark, sf):
    source, target = scratch_path(spark, "orders-csv"), scratch_path(spark, "orders-landed")
    writers.write_csv(table(spark, sf, "orders"), source)
    landed = readers.land_delimited(spark, source, target)
    return landed.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.to_date(F.left("o_orderdate", F.lit(10))).alias("o_orderdate"), "o_orderpriority",
    )


@query("a13_json_landing", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, event_type, value, props FROM events")
def a13_json(spark, sf):
    source, target = scratch_path(spark, "events-json"), scratch_path(spark, "events-landed")
    table(spark, sf, "events").write.json(source)
    landed = readers.land_json(spark, source, target)
    parsed = landed.select(F.from_json("value", "event_id long, ts string, user_id long, event_type string, value double, props string").alias("e"))
    return parsed.select("e.*").withColumn("ts", F.left("ts", F.lit(19)))


CTES["seed_files"] = """
    SELECT TRY_CAST(reading_time AS TIMESTAMP) AS "timestamp", node_id, pressure, flow, demand, leak_label,
      CASE WHEN source_type = 'real' THEN pressure_unit ELSE 'psi' END AS pressure_unit,
      CASE WHEN source_type = 'real' THEN flow_unit ELSE 'gpm' END AS flow_unit,
      CASE WHEN source_type = 'real' THEN demand_unit ELSE 'gpm' END AS demand_unit
    FROM bronze_rows WHERE TRY_CAST(reading_time AS TIMESTAMP) IS NOT NULL"""


def seed_folder(spark, sf):
    """Two feeds, one without unit columns, next to files that hold no readings."""
    from pipewatch.catalog.medallion import bronze_frame

    path = scratch_path(spark, "seeds")
    rows = bronze_frame(spark, sf)
    writers.write_csv(rows.filter("_source_type = 'real'").select(*NINE), f"{path}/with_units")
    bare = rows.filter("_source_type <> 'real'").select(*schemas.CORE_COLUMNS)
    writers.write_csv(bare, f"{path}/without_units")
    writers.write_csv(view(spark, sf, "network_nodes"), f"{path}/nodes")
    return path


@query("a14_seed_readings", "SELECT * FROM seed_files")
def a14(spark, sf):
    return readers.read_seed_readings(spark, seed_folder(spark, sf))


@query(
    "g3_feed_union",
    "SELECT pressure_unit, flow_unit, demand_unit, count(*) AS readings FROM seed_files GROUP BY 1, 2, 3",
)
def g3(spark, sf):
    rows = readers.read_seed_readings(spark, seed_folder(spark, sf))
    return rows.groupBy("pressure_unit", "flow_unit", "demand_unit").agg(
        F.count(F.lit(1)).alias("readings")
    )


@query(
    "a15_threshold_csv",
    "SELECT round(threshold, 6) AS threshold, tn, fp, fn, tp, round(business_net_value, 6) AS business_net_value FROM grid_metrics",
)
def a15(spark, sf):
    path = scratch_path(spark, "sweep")
    columns = ["threshold", "tn", "fp", "fn", "tp", "business_net_value"]
    writers.write_csv(m.sweep(mc.scored(spark, sf), mc.ORDER).select(*columns), path)
    schema = "threshold double, tn long, fp long, fn long, tp long, business_net_value double"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query(
    "b14_column_contract",
    "SELECT 'reading_id' AS missing_column, count(*) AS readings FROM telemetry_raw",
)
def b14(spark, sf):
    """The header of the landed files against a contract that asks for one column more."""
    from pipewatch.operators.quality import missing_columns

    path = f"{raw_folder(spark, sf)}/leakg3pd_sample.csv"
    missing = missing_columns(readers.file_headers(spark, path), [*NINE, "reading_id"])
    readings = readers.read_telemetry(spark, path).agg(F.count(F.lit(1)).alias("readings"))
    return missing.select("missing_column").distinct().select("missing_column", readings.scalar().alias("readings"))


_CANDIDATES = sorted(
    [*_GOLD_OUT, "hour_of_day", "day_of_week", "is_weekend", "node_degree"]
)


@query(
    "b15_candidate_features",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} <> 0) AS nonzero_rows, false AS leaks_target
            FROM gold_rows"""
        for c in _CANDIDATES
    ),
)
def b15(spark, sf):
    """Numeric, non-identifying gold columns, with the leakage guard's verdict."""
    from pipewatch.operators.models import candidate_features, leaking_features

    gold = gold_frame(spark, sf)
    names = candidate_features(gold)
    leaking = set(leaking_features(names))
    filled = gold.agg(*[F.count_if(F.col(n) != 0).alias(n) for n in names])
    long = filled.unpivot([], names, "feature", "nonzero_rows")
    return long.withColumn("leaks_target", F.col("feature").isin(*leaking) if leaking else F.lit(False))
