"""Data-quality checks over raw readings and the network and incident tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pipewatch.functions.expr import flag, ratio, seconds_between
from pipewatch.operators.series import over_series
from pipewatch.operators.silver import event_time, known_nodes

# Accepted ranges of the raw measures.
RANGES = {"pressure": (0, 200), "flow": (0, 10000), "demand": (0, 10000)}


def total(condition: Column) -> Column:
    """How many rows meet the condition; 0 on an empty table."""
    return F.coalesce(F.sum(flag(condition).cast("long")), F.lit(0))


def counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("long")
    )


def time_range(df: DataFrame, time: Column) -> DataFrame:
    return df.agg(
        F.min(time).alias("min_timestamp"),
        F.max(time).alias("max_timestamp"),
        total(time.isNull()).alias("null_timestamp_rows"),
    )


def sampling_gaps(df: DataFrame, key: str, time: str) -> DataFrame:
    """gap_seconds to the previous reading of the series; NULL for the first."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("gap_seconds", seconds_between(F.lag(time).over(w), F.col(time)))

    return over_series(df, key, [F.col(time).asc()], compute, lookback=1)


def sampling_interval(df: DataFrame, key: str, time: str) -> DataFrame:
    gaps = sampling_gaps(df.select(key, time), key, time).filter("gap_seconds > 0")
    return gaps.agg(
        F.min("gap_seconds").alias("min_interval_seconds"),
        F.avg("gap_seconds").alias("mean_interval_seconds"),
        F.max("gap_seconds").alias("max_interval_seconds"),
    )


def all_measured() -> Column:
    return F.col("pressure").isNotNull() & F.col("flow").isNotNull() & F.col("demand").isNotNull()


def alignment(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), total(all_measured()).alias("aligned_rows")
    ).withColumn("aligned_ratio", ratio(F.col("aligned_rows"), F.col("total_rows")))


def label_distribution(df: DataFrame, label: str = "leak_label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("readings")).orderBy(label)


def bad_labels(label: Column) -> Column:
    return total(label.isNotNull() & ~label.isin(0, 1))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column, from one pass."""
    one = df.agg(*[total(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "null_rows")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups sharing the keys, and the rows beyond the first of each."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sizes.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"),
    )


def outlier(name: str) -> Column:
    low, high = RANGES[name]
    return (F.col(name) < low) | (F.col(name) > high)


def outliers(df: DataFrame) -> DataFrame:
    return df.agg(*[total(outlier(m)).alias(f"{m}_outliers") for m in RANGES])


def metadata_validity(metadata: DataFrame) -> DataFrame:
    start, end = event_time("start_time"), event_time("end_time")
    return metadata.agg(
        F.count(F.lit(1)).alias("row_count"),
        total(start.isNull() | end.isNull() | (end < start)).alias("invalid_time_rows"),
    )


def orphan_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with an end, or no end at all, outside the node list."""
    known = known_nodes(nodes)
    start = known.select(F.col("node_id").alias("_from"))
    finish = known.select(F.col("node_id").alias("_to"))
    return (
        links.join(start, links["from_node"] == start["_from"], "left")
        .join(finish, links["to_node"] == finish["_to"], "left")
        .filter(F.col("_from").isNull() | F.col("_to").isNull())
        .drop("_from", "_to")
    )


def missing_columns(headers: DataFrame, expected: list[str]) -> DataFrame:
    """(file, missing_column): a row for each expected column that a file's header lacks."""
    wanted = F.array(*[F.lit(c) for c in expected])
    return headers.select("file", F.explode(F.array_except(wanted, "columns")).alias("missing_column"))


def single_pass(df: DataFrame, time: Column) -> DataFrame:
    """Every check that needs only row-wise counts, as one aggregate, in long form."""
    epoch = F.unix_timestamp(time).cast("double")
    measures = {
        "row_column_counts.row_count": F.count(F.lit(1)),
        "row_column_counts.column_count": F.lit(len(df.columns)),
        "timestamps.min_epoch": F.min(epoch),
        "timestamps.max_epoch": F.max(epoch),
        "timestamps.null_timestamp_rows": total(time.isNull()),
        "pressure_flow_demand_alignment.aligned_rows": total(all_measured()),
        "pressure_flow_demand_alignment.aligned_ratio": ratio(
            total(all_measured()), F.count(F.lit(1))
        ),
        "labels.outside_domain": bad_labels(F.col("leak_label")),
        "labels.normal_rows": total(F.col("leak_label") == 0),
        "labels.leak_rows": total(F.col("leak_label") == 1),
        **{f"missing_values.{c}": total(F.col(c).isNull()) for c in df.columns},
        **{
            f"invalid_or_outlier_sensor_values.{m}_outliers": total(outlier(m)) for m in RANGES
        },
    }
    one = df.agg(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(measures.values())])
    pairs = ", ".join(f"'{name}', m{i}" for i, name in enumerate(measures))
    return one.selectExpr(f"stack({len(measures)}, {pairs}) AS (check, value)")


def _long(one_row: DataFrame, prefix: str) -> DataFrame:
    named = one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns])
    long = named.unpivot([], named.columns, "check", "value")
    return long.withColumn("check", F.concat(F.lit(f"{prefix}."), "check"))


def data_quality_report(
    telemetry: DataFrame,
    metadata: DataFrame | None = None,
    nodes: DataFrame | None = None,
    links: DataFrame | None = None,
    headers: DataFrame | None = None,
    inventory: DataFrame | None = None,
    expected_columns: list[str] | None = None,
) -> DataFrame:
    """All checks as (check, value) rows; ``found`` rows tell inputs that are absent from empty ones.

    ``headers`` (file, columns) are the readings' real headers; the contract is checked file by file.
    """
    time = event_time("timestamp")
    timed = telemetry.select("node_id", time.alias("event_ts"))
    parts = [
        single_pass(telemetry, time),
        _long(sampling_interval(timed, "node_id", "event_ts"), "sampling_interval_seconds"),
        _long(duplicate_groups(telemetry, ["timestamp", "node_id"]), "duplicates"),
    ]
    if metadata is not None:
        parts.append(_long(metadata_validity(metadata), "leak_metadata"))
    if nodes is not None and links is not None:
        orphans = orphan_links(links, nodes).agg(F.count(F.lit(1)).alias("orphan_link_rows"))
        parts.append(_long(orphans, "epanet_network_topology"))
    found = {"leak_metadata.found": metadata is not None, "epanet_network_topology.found": nodes is not None and links is not None}
    flags = [(name, float(value)) for name, value in found.items()]
    parts.append(telemetry.sparkSession.createDataFrame(flags, "check string, value double"))
    if inventory is not None:
        parts.append(_long(inventory.agg(F.count(F.lit(1)).alias("entries")), "file_inventory"))
    if headers is not None and expected_columns is not None:
        missing = missing_columns(headers, expected_columns)
        parts.append(_long(missing.agg(F.count_distinct("missing_column").alias("missing_columns")), "schemas"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
