"""Raw readings with lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SEPARATOR = "||"
HASHED = ("timestamp", "node_id", "pressure", "flow", "demand", "leak_label")


def source_type(source_file: Column) -> Column:
    """synthetic when the path says so, else real."""
    path = F.lower(source_file)
    synthetic = path.contains("/raw_synthetic/") | path.contains("synth_")
    return F.when(synthetic, F.lit("synthetic")).otherwise(F.lit("real"))


def row_hash() -> Column:
    """sha256 over the reading's values; NULLs are skipped and units left out."""
    return F.sha2(F.concat_ws(HASH_SEPARATOR, *[F.col(c).cast("string") for c in HASHED]), 256)


def bronze(raw: DataFrame, source_file: Column | None = None, ingest_ts: Column | None = None) -> DataFrame:
    """Add ingest time, source file and type, job name, schema version and row hash.

    Without arguments the file comes from the scan and the time from the clock.
    """
    file = F.col("_metadata.file_path") if source_file is None else source_file
    when = F.current_timestamp() if ingest_ts is None else ingest_ts
    lineage = raw.withColumns({"_ingest_ts": when, "_source_file": file})
    return lineage.withColumns(
        {
            "_source_type": source_type(F.col("_source_file")),
            "_ingest_job": F.lit("bronze_ingest"),
            "_schema_version": F.lit("v1"),
            "_row_hash": row_hash(),
        }
    )
