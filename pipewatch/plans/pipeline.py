"""Batch jobs from raw files to features: bronze, silver, gold, validation, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewatch.operators import bronze as bz
from pipewatch.operators import gold as gd
from pipewatch.operators import quality as q
from pipewatch.operators import scenarios as sc
from pipewatch.operators import silver as sv
from pipewatch.sources import readers, schemas, writers


def bronze(spark: SparkSession, raw: str, out: str, synthetic_raw: str = "", fmt: str = "parquet") -> DataFrame:
    """Raw CSV to the bronze table."""
    readings = readers.read_telemetry(spark, raw, synthetic_raw or None)
    return writers.write_table(bz.bronze(readings), out, fmt)


def silver(spark: SparkSession, bronze_path: str, out: str, raw: str, quarantine: str,
           fmt: str = "parquet") -> DataFrame:
    """Bronze to silver and quarantine. Network and incident files are optional."""
    rows = spark.read.format(fmt).load(bronze_path)
    nodes, metadata = readers.read_nodes(spark, raw), readers.read_leak_metadata(spark, raw)
    writers.write_table(sv.quarantined(rows, nodes, metadata), quarantine, fmt)
    return writers.write_table(sv.silver(rows, nodes, metadata), out, fmt)


def gold(spark: SparkSession, silver_path: str, out: str, raw: str, horizon: int = 1,
         dictionary: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Silver to gold features, with the feature dictionary beside them."""
    rows = spark.read.format(fmt).load(silver_path)
    made = writers.write_table(gd.gold(rows, readers.read_links(spark, raw), horizon), out, fmt)
    if dictionary:
        described = gd.feature_dictionary(made).filter("description IS NOT NULL")
        writers.write_document(described, dictionary)
    return made


def validate(spark: SparkSession, raw: str, report: str, telemetry: str | None = None) -> DataFrame:
    """Data-quality report of a landing folder, written as JSON documents.

    ``telemetry`` names the readings when they lie in a folder of their own.
    """
    source = telemetry or raw
    checks = q.data_quality_report(
        readers.read_telemetry(spark, source),
        readers.read_leak_metadata(spark, raw),
        readers.read_nodes(spark, raw),
        readers.read_links(spark, raw),
        headers=readers.file_headers(spark, source),
        inventory=readers.file_inventory(spark, raw),
        expected_columns=schemas.columns(schemas.TELEMETRY),
    )
    writers.write_document(checks, report)
    return spark.read.schema("check string, value double").json(report)


def augment(spark: SparkSession, folder: str, out: str, multiplier: int = 40,
            leak_boost: float = 1.2, seed: int = 42) -> DataFrame:
    """Synthetic readings from every telemetry CSV of a folder; returns the summary."""
    seeds = readers.read_seed_readings(spark, folder)
    order = [F.col(c) for c in seeds.columns]
    made = sc.augment(seeds, order, multiplier, leak_boost, seed)
    text = made.withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).drop("sample_id")
    writers.write_csv(text.orderBy("timestamp", "node_id"), out)
    return sc.augmentation_summary(seeds, readers.read_telemetry(spark, out))
