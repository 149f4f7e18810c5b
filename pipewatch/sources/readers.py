"""Readers for the files the jobs take in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewatch.sources import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def _csv(spark: SparkSession, schema: str):
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")


def read_telemetry(
    spark: SparkSession, path: str, synthetic_path: str | None = None, include_aux: bool = False
) -> DataFrame:
    """Raw readings from CSV, plus the synthetic folder when it exists.

    The raw folder also holds the network and incident files. They are left
    out by file name; ``include_aux=True`` reads them as readings too.
    """
    paths = [path]
    if synthetic_path and path_exists(spark, synthetic_path):
        paths.append(synthetic_path)
    readings = _csv(spark, schemas.TELEMETRY).csv(paths)
    if include_aux:
        return readings
    return readings.filter(~F.col("_metadata.file_name").isin(*schemas.AUXILIARY_FILES))


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A small reference table, or None when its file is absent."""
    return _csv(spark, schema).csv(path) if path_exists(spark, path) else None


def read_leak_metadata(spark: SparkSession, raw_path: str) -> DataFrame | None:
    return read_reference(spark, f"{raw_path.rstrip('/')}/leak_metadata.csv", schemas.LEAK_METADATA)


def read_nodes(spark: SparkSession, raw_path: str) -> DataFrame | None:
    return read_reference(spark, f"{raw_path.rstrip('/')}/net3_nodes.csv", schemas.NETWORK_NODES)


def read_links(spark: SparkSession, raw_path: str) -> DataFrame | None:
    return read_reference(spark, f"{raw_path.rstrip('/')}/net3_links.csv", schemas.NETWORK_LINKS)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder with their file count and bytes; contents are not read."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.element_at(F.split(F.col("path"), re.escape(root) + "/", 2), 2)
    return (
        files.groupBy(F.split(below, "/")[0].alias("entry"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        .orderBy("entry")
    )


def inventory_check(inventory: DataFrame, expected=schemas.EXPECTED_FILES) -> DataFrame:
    """Each expected entry with whether it is there."""
    spark = inventory.sparkSession
    wanted = spark.createDataFrame([(f,) for f in expected], "entry string")
    found = inventory.select("entry", F.lit(True).alias("found"))
    return wanted.join(found, "entry", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def read_jsonl_maps(spark: SparkSession, path: str) -> DataFrame:
    """One map per non-blank JSON line, so the keys present in each row are kept."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "line string, row map<string,string>")
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    return lines.withColumn("row", F.from_json("line", "map<string,string>"))


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """The typed prediction log; a missing file is an empty log."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.PREDICTION_LOG)
    return spark.read.schema(schemas.PREDICTION_LOG).json(path)


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """The knowledge corpus; an empty one is an error."""
    corpus = spark.read.schema(schemas.KNOWLEDGE).json(path)
    if corpus.isEmpty():
        raise ValueError(f"no documents in {path}")
    return corpus


def read_classification_reports(spark: SparkSession, path: str) -> DataFrame:
    """One nested report per model, flattened to a row per model."""
    scores = "struct<precision:double,recall:double,`f1-score`:double,support:double>"
    split = f"struct<no_leak:{scores},leak:{scores},accuracy:double>"
    reports = spark.read.schema(
        f"model string, threshold double, validation {split}, test {split}"
    ).option("multiLine", True).json(path)
    leak = F.col("test.leak")
    return reports.select(
        "model",
        "threshold",
        F.col("test.accuracy").alias("accuracy"),
        leak["precision"].alias("precision"),
        leak["recall"].alias("recall"),
        leak["f1-score"].alias("f1"),
        leak["support"].cast("long").alias("support"),
    )


def with_unit_defaults(df: DataFrame) -> DataFrame:
    """The nine telemetry columns, absent unit columns filled with their default."""
    present = [F.col(c) for c in schemas.CORE_COLUMNS]
    units = [
        (F.col(c) if c in df.columns else F.lit(default)).alias(c)
        for c, default in schemas.UNIT_DEFAULTS.items()
    ]
    return df.select(*present, *units)


def read_seed_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings from every CSV below ``folder`` that has the core columns.

    Headers are found by scanning for lines that hold every core column name;
    files sharing a header are read together.
    """
    tokens = F.split(F.trim("value"), r"\s*,\s*")
    is_header = F.lit(True)
    for name in schemas.CORE_COLUMNS:
        is_header = is_header & F.array_contains(tokens, name)
    lines = (
        spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(folder)
    )
    headers = (
        lines.filter(is_header)
        .select(F.trim("value").alias("header"), F.col("_metadata.file_path").alias("file"))
        .distinct()
        .groupBy("header")
        .agg(F.collect_list("file").alias("files"))
        .collect()
    )
    if not headers:
        raise ValueError(f"no telemetry CSV with the core columns in {folder}")
    parts = []
    for found in headers:
        names = [n.strip() for n in found["header"].split(",")]
        types = {"pressure": "double", "flow": "double", "demand": "double", "leak_label": "int"}
        schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
        parts.append(with_unit_defaults(_csv(spark, schema).csv(list(found["files"]))))
    seeds = parts[0]
    for part in parts[1:]:
        seeds = seeds.unionByName(part)
    return seeds.withColumn("timestamp", F.try_to_timestamp("timestamp")).dropna(
        subset=["timestamp"]
    )


def land_delimited(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy delimited text to Parquet as it is."""
    spark.read.option("header", True).csv(source).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def land_json(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy JSON lines to JSON as they are."""
    spark.read.text(source).write.mode("overwrite").text(target)
    return spark.read.text(target)


def file_headers(spark: SparkSession, path: str, include_aux: bool = False) -> DataFrame:
    """(file, columns) of every CSV at or below ``path``: the names in its own first line.

    Auxiliary files, told by a part of their path, are left out.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(path)
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    ).filter("start = 0")
    if not include_aux:
        parts = F.split("file", "/")
        placed = placed.filter(~F.exists(parts, lambda p: p.isin(*schemas.AUXILIARY_FILES)))
    first = placed.withColumn("place", F.monotonically_increasing_id())
    header = first.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    return header.select("file", F.split(F.trim("header"), r"\s*,\s*").alias("columns"))

