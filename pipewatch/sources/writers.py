"""Writers of the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Replace the table at ``path`` and return it as written."""
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def write_document(df: DataFrame, path: str) -> DataFrame:
    """One JSON object per row, as text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
