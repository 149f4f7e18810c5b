"""Service, drift and outcome metrics over prediction logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.functions.expr import ratio, row_scalars
from pipewatch.operators.ordered import lower_quantiles

BINS = 10
RATIO_FLOOR = 1e-9


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# --- aggregates usable in one pass, plain or per window -----------------------------

SERVICE: dict[str, Callable[[], Column]] = {
    "average_latency_ms": lambda: or_zero(F.avg("latency_ms")),
    "throughput_rps_estimate": lambda: F.when(
        F.count("latency_ms") > 0,
        F.count("latency_ms") / F.greatest(F.sum("latency_ms") / 1000, F.lit(1e-9)),
    ).otherwise(0.0),
    # A missing status counts as a success in one rate and as a failure in the other.
    "error_rate": lambda: or_zero(
        F.avg(F.when(F.coalesce("status_code", F.lit(200)) >= 400, 1.0).otherwise(0.0))
    ),
    "availability": lambda: or_zero(
        F.avg(F.when(F.coalesce("status_code", F.lit(500)) < 500, 1.0).otherwise(0.0))
    ),
}
RESOURCES: dict[str, Callable[[], Column]] = {
    "avg_cpu_percent": lambda: or_zero(F.avg("cpu_percent")),
    "avg_memory_percent": lambda: or_zero(F.avg("memory_percent")),
}


def _labelled() -> Column:
    return F.col("actual_label").isin(0, 1)


def _rate(actual: int, predicted: int) -> Column:
    of_class = F.col("actual_label") == actual
    wrong = of_class & (F.coalesce("predicted_label", F.lit(0)) == predicted)
    return F.count_if(wrong) / F.greatest(F.count_if(of_class), F.lit(1))


OUTCOMES: dict[str, Callable[[], Column]] = {
    "false_alarm_rate": lambda: _rate(0, 1),
    "missed_leak_rate": lambda: _rate(1, 0),
    "avg_detection_delay_minutes": lambda: or_zero(
        F.avg(F.when(_labelled(), F.col("detection_delay_minutes")))
    ),
    "avg_business_impact_usd": lambda: or_zero(F.avg("estimated_business_impact_usd")),
}


def measures(*groups: dict[str, Callable[[], Column]]) -> list[Column]:
    return [make().alias(name) for group in groups for name, make in group.items()]


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def latency(log: DataFrame) -> DataFrame:
    """Mean and lower-nearest-rank p95 and p99, 0 on an empty log."""
    tails = row_scalars(lower_quantiles(log, "latency_ms", {"p95": 0.95, "p99": 0.99}))
    mean = log.agg(or_zero(F.avg("latency_ms")).alias("average_latency_ms"))
    return mean.withColumns(
        {
            "p95_latency_ms": or_zero(tails["p95"]),
            "p99_latency_ms": or_zero(tails["p99"]),
        }
    )


def labelled_predictions(log: DataFrame, outcomes: DataFrame | None = None, key: str = "event_id") -> DataFrame:
    """Rows with a 0/1 label; labels that arrive later are joined on the key."""
    if outcomes is not None:
        log = log.drop("actual_label").join(outcomes.select(key, "actual_label"), key)
    return log.filter(_labelled())


# --- cells, duplicates and keys of free-form rows ----------------------------------


def row_quality(rows: DataFrame) -> DataFrame:
    """Missing cells among the cells present, and repeated rows, of map rows."""
    cells = rows.agg(
        F.sum(F.size("row")).alias("cells"),
        F.sum(F.size(F.filter(F.map_values("row"), lambda v: v.isNull()))).alias("missing"),
        F.count(F.lit(1)).alias("rows"),
    )
    one_key = F.md5(F.to_json(F.array_sort(F.map_entries("row"))))
    sizes = rows.groupBy(one_key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
    repeated = sizes.agg(F.sum(F.col("n") - 1).alias("repeated"))
    return cells.withColumn("repeated", repeated.scalar()).select(
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("cells", F.lit(0)).cast("long").alias("cells"),
        F.coalesce("missing", F.lit(0)).cast("long").alias("missing_cells"),
        F.coalesce("repeated", F.lit(0)).alias("duplicate_rows"),
        ratio(F.col("missing"), F.col("cells")).alias("missing_rate"),
        ratio(F.col("repeated"), F.col("rows")).alias("duplicate_rate"),
    )


def schema_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Keys added to or removed from the rows: (change, column_name)."""

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.map_keys("row")).alias("column_name")).distinct()

    before, now = keys(baseline), keys(current)
    added = now.subtract(before).select(F.lit("added").alias("change"), "column_name")
    removed = before.subtract(now).select(F.lit("removed").alias("change"), "column_name")
    return added.unionByName(removed)


# --- drift --------------------------------------------------------------------------


def psi_by_feature(values: DataFrame, period: str | None = None) -> DataFrame:
    """PSI per feature of long rows (feature, side, value), side baseline or current.

    Ten equal bins over the pooled range; 0 when a side is empty or the range is
    nil. With ``period`` every period of the current side is measured against
    the one histogram of the baseline, over bins pooled from all periods.
    """
    rows = values.filter(F.col("value").isNotNull())
    ranges = rows.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = (F.col("high") - F.col("low")) / BINS
    index = F.least(F.floor(F.try_divide(F.col("value") - F.col("low"), width)), F.lit(BINS - 1))
    # One range per feature name: as many rows as columns watched.
    binned = rows.join(F.broadcast(ranges), "feature").withColumn("bin", index.cast("int"))
    if period:
        binned = binned.withColumn(period, F.when(F.col("side") == "current", F.col(period)))
    counts = F.array(*[F.count_if(F.col("bin") == b) for b in range(BINS)])
    keys = ["feature", "low", "high"]
    parts = binned.groupBy(*keys, "side", *([period] if period else [])).agg(
        F.struct(F.count(F.lit(1)).alias("n"), counts.alias("bins")).alias("hist")
    )
    base = F.max(F.when(F.col("side") == "baseline", F.col("hist")))
    curr = F.max(F.when(F.col("side") == "current", F.col("hist")))
    if period:
        # A handful of histograms by now: one per feature and period.
        sides = (
            parts.withColumn("base", base.over(Window.partitionBy("feature")))
            .filter(F.col("side") == "current")
            .withColumn("curr", F.col("hist"))
        )
    else:
        sides = parts.groupBy(*keys).agg(base.alias("base"), curr.alias("curr"))

    def term(pair: Column) -> Column:
        b = F.greatest(pair["0"] / F.col("base.n"), F.lit(RATIO_FLOOR))
        c = F.greatest(pair["1"] / F.col("curr.n"), F.lit(RATIO_FLOOR))
        return (c - b) * F.log(c / b)

    pairs = F.arrays_zip(F.col("base.bins").alias("0"), F.col("curr.bins").alias("1"))
    total = F.aggregate(F.transform(pairs, term), F.lit(0.0), lambda acc, t: acc + t)
    span = F.abs(F.col("high") - F.col("low"))
    close = span <= 1e-9 * F.greatest(F.abs("high"), F.abs("low"))
    unusable = F.col("base").isNull() | F.col("curr").isNull() | close
    return sides.select(
        "feature", *([period] if period else []), F.when(unusable, 0.0).otherwise(total).alias("psi")
    )


def long_features(df: DataFrame, features: list[str], side: str = "side") -> DataFrame:
    return df.select(
        F.col(side).alias("side"), *[F.col(f).cast("double").alias(f) for f in features]
    ).unpivot("side", features, "feature", "value")


def feature_drift(df: DataFrame, features: list[str], side: str = "side", limit: float = 0.2) -> DataFrame:
    """PSI of every feature column and whether it passed the limit."""
    return psi_by_feature(long_features(df, features, side)).withColumn(
        "drifted", F.col("psi") > limit
    )


def monitoring_report(log: DataFrame, baseline_rows: DataFrame, current_rows: DataFrame) -> DataFrame:
    """The whole report as one row: ``log`` has both sides, the map rows feed the row checks."""
    current = log.filter("side = 'current'")
    one = current.agg(*measures(SERVICE, RESOURCES, OUTCOMES))
    tails = row_scalars(lower_quantiles(current, "latency_ms", {"p95": 0.95, "p99": 0.99}))
    drift = row_scalars(
        psi_by_feature(long_features(log, ["score", "confidence"]))
        .groupBy()
        .agg(
            F.max(F.when(F.col("feature") == "score", F.col("psi"))).alias("score"),
            F.max(F.when(F.col("feature") == "confidence", F.col("psi"))).alias("confidence"),
        )
    )
    quality = row_scalars(row_quality(current_rows))
    changes = schema_changes(baseline_rows, current_rows)

    def named(change: str) -> Column:
        names = F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("column_name"))))
        return F.array_join(names, ",")

    names = row_scalars(changes.agg(named("added").alias("added"), named("removed").alias("removed")))
    return one.withColumns(
        {
            "p95_latency_ms": or_zero(tails["p95"]),
            "p99_latency_ms": or_zero(tails["p99"]),
            "missing_rate": quality["missing_rate"],
            "duplicate_rate": quality["duplicate_rate"],
            "added_columns": names["added"],
            "removed_columns": names["removed"],
            "prediction_drift_psi": or_zero(drift["score"]),
            "confidence_drift_psi": or_zero(drift["confidence"]),
        }
    )


def request_summary(log: DataFrame, time: str = "ts") -> DataFrame:
    """Load-test style summary: a call without status timed out; other answers below 400 but 200 are network errors."""
    status = F.col("status_code")
    instant = F.col(time).cast("timestamp")
    seconds = (F.unix_micros(F.max(instant)) - F.unix_micros(F.min(instant))) / F.lit(1e6)
    ok = status == 200
    one = log.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(ok).alias("successes"),
        ratio(F.count_if(ok), F.count(F.lit(1))).alias("success_rate"),
        seconds.alias("duration_seconds"),
        (F.count(F.lit(1)) / F.greatest(seconds, F.lit(1e-9))).alias("throughput_rps"),
        F.avg("latency_ms").alias("latency_ms_avg"),
        F.count_if(status.isNull()).alias("timeouts"),
        F.count_if(status >= 400).alias("http_errors"),
        F.count_if((status < 400) & ~ok).alias("network_errors"),
    )
    tails = row_scalars(lower_quantiles(log, "latency_ms", {"p95": 0.95, "p99": 0.99}))
    return one.withColumns(
        {
            "latency_ms_p95": tails["p95"],
            "latency_ms_p99": tails["p99"],
        }
    )
