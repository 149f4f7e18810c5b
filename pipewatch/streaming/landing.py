"""Landing of raw events and the incremental bronze table; ``medallion`` goes on from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipewatch.operators import bronze as bz


def text_source(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Files of one event per line, as they arrive."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).filter(F.trim("value") != "")


def broker_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events from a Kafka-protocol broker, from the beginning; needs Spark's Kafka package."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def well_formed(value: Column | str) -> Column:
    """The line is one JSON object."""
    text = F.trim(value)
    return text.startswith("{") & F.try_parse_json(text).isNotNull()


def with_arrival(events: DataFrame, arrival: Column | None = None) -> DataFrame:
    at = F.current_timestamp() if arrival is None else arrival
    return events.withColumns(
        {
            "year": F.date_format(at, "yyyy"),
            "month": F.date_format(at, "MM"),
            "day": F.date_format(at, "dd"),
        }
    )


def land_events(events: DataFrame, target: str, checkpoint: str, arrival: Column | None = None) -> StreamingQuery:
    """Every event to year=/month=/day= folders by arrival; each event lands exactly once."""
    return (
        with_arrival(events, arrival)
        .writeStream.format("text")
        .partitionBy("year", "month", "day")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def land_with_quarantine(events: DataFrame, target: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Well-formed events to one table, the rest to another.

    Each batch overwrites its own folder, so a batch that is run again after a
    failure leaves one copy.
    """

    def split(batch: DataFrame, number: int) -> None:
        good = well_formed("value")
        batch.filter(good).write.mode("overwrite").text(f"{target}/batch={number}")
        batch.filter(~good | good.isNull()).write.mode("overwrite").text(f"{rejected}/batch={number}")

    return (
        events.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def bronze_stream(readings: DataFrame, target: str, checkpoint: str, source_file: Column,
                  ingest_ts: Column) -> StreamingQuery:
    """New readings appended to the bronze table."""
    return (
        bz.bronze(readings, source_file, ingest_ts)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
