"""Windowed service metrics, sustained breaches and the rules built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.operators.monitoring import OUTCOMES, SERVICE, measures, psi_by_feature
from pipewatch.operators.ordered import lower_quantiles


def server_error_rate() -> Column:
    """Share of 5xx answers; a missing status is no answer of the server."""
    return F.avg(F.when(F.col("status_code") >= 500, 1.0).otherwise(0.0))


def windowed(log: DataFrame, size: str, slide: str | None, aggs: list[Column], time: str = "ts") -> DataFrame:
    """Aggregates per event-time window, with its borders."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        log.groupBy(span.alias("w"))
        .agg(*aggs)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*")
        .drop("w")
    )


def service_windows(log: DataFrame, size: str = "15 minutes", time: str = "ts") -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("requests"),
        server_error_rate().alias("error_rate_5xx"),
        SERVICE["availability"]().alias("availability"),
    ]
    return windowed(log, size, None, aggs, time)


def sliding_alerts(
    log: DataFrame,
    time: str = "ts",
    short: tuple[str, str] = ("5 minutes", "1 minute"),
    long: tuple[str, str] = ("15 minutes", "5 minutes"),
    max_duration_ms: float = 1000.0,
    max_failed: int = 5,
    min_availability: float = 0.995,
) -> DataFrame:
    """Alert windows: mean duration and failed requests on the short one, availability on the long."""
    failed = F.count_if(F.coalesce("status_code", F.lit(500)) >= 500)
    quick = windowed(
        log, *short, [F.avg("latency_ms").alias("duration"), failed.cast("double").alias("failed")], time
    )
    slow = windowed(log, *long, [SERVICE["availability"]().alias("availability")], time)

    def rule(df: DataFrame, name: str, value: str, breached: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("alert"), "window_start", "window_end", F.col(value).alias("value")
        ).filter(breached)

    value = F.col("value")
    return (
        rule(quick, "latency", "duration", value > max_duration_ms)
        .unionByName(rule(quick, "failed_requests", "failed", value > max_failed))
        .unionByName(rule(slow, "availability", "availability", value < min_availability))
    )


def period_metrics(log: DataFrame, period: str = "minute", time: str = "ts") -> DataFrame:
    """Tail latency, error rate, availability and resource load per period."""
    timed = log.withColumn("period_start", F.date_trunc(period, F.col(time)))
    tails = lower_quantiles(
        timed, "latency_ms", {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}, ("period_start",)
    ).drop("n")
    rates = timed.groupBy("period_start").agg(
        server_error_rate().alias("error_rate_5xx"),
        SERVICE["availability"]().alias("availability"),
        F.avg("cpu_percent").alias("cpu_percent"),
        F.avg("memory_percent").alias("memory_percent"),
    )
    return rates.join(tails, "period_start", "left")


# Fixed values: (rule, severity, metric, comparison, limit, periods it must last).
ALERT_RULES = [
    ("availability_low", "critical", "availability", "<", 0.99, 15),
    ("p95_latency_high", "warning", "p95_latency_ms", ">", 1000.0, 10),
    ("p99_latency_high", "critical", "p99_latency_ms", ">", 1500.0, 10),
    ("error_rate_high", "critical", "error_rate_5xx", ">", 0.02, 10),
    ("cpu_high", "warning", "cpu_percent", ">", 80.0, 15),
    ("memory_high", "warning", "memory_percent", ">", 80.0, 15),
]
SCALE_OUT_RULES = [
    ("scale_out_latency", "out", "p95_latency_ms", ">", 1000.0, 10),
    ("scale_out_cpu", "out", "cpu_percent", ">", 70.0, 10),
]


def compare(value: Column, op: str, limit: Column | float) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return {
        "<": value < limit,
        "<=": value <= limit,
        ">": value > limit,
        ">=": value >= limit,
    }[op]


def runs(breaches: DataFrame, by: list[str], period_number: str, time: str) -> DataFrame:
    """Unbroken runs of breached periods: start, end and length.

    One row per period reaches this point, so a rule's whole history is short.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(period_number))
    return (
        breaches.withColumn("island", F.col(period_number) - place)
        .groupBy(*by, "island")
        .agg(
            F.min(time).alias("breach_start"),
            F.max(time).alias("breach_last"),
            F.count(F.lit(1)).alias("periods"),
        )
        .drop("island")
    )


def sustained_breaches(
    periods: DataFrame, rules=ALERT_RULES, seconds_per_period: int = 60
) -> DataFrame:
    """Runs in which a rule's metric stayed beyond its limit for long enough."""
    checks = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(severity).alias("severity"),
                F.lit(least).cast("long").alias("least"),
                F.coalesce(compare(F.col(metric), op, limit), F.lit(False)).alias("breached"),
            )
            for rule, severity, metric, op, limit, least in rules
        ]
    )
    breached = (
        periods.select("period_start", F.explode(checks).alias("c"))
        .select("period_start", "c.*")
        .filter("breached")
        .withColumn(
            "number",
            F.floor(F.unix_timestamp(F.col("period_start").cast("timestamp")) / seconds_per_period),
        )
    )
    found = runs(breached, ["rule", "severity", "least"], "number", "period_start")
    return found.filter("periods >= least").drop("least")


def scale_recommendations(periods: DataFrame, seconds_per_period: int = 60,
                          rules=SCALE_OUT_RULES, quiet_periods: int = 30,
                          quiet_p95: float = 400.0, quiet_cpu: float = 40.0) -> DataFrame:
    """Scale out on sustained latency or CPU, scale in after a long quiet stretch."""
    out = sustained_breaches(periods, rules, seconds_per_period)
    quiet = (F.col("p95_latency_ms") < quiet_p95) & (F.col("cpu_percent") < quiet_cpu)
    calm = periods.withColumn("quiet", F.when(quiet, 1.0).otherwise(0.0))
    calm_rule = [("scale_in_quiet", "in", "quiet", ">", 0.5, quiet_periods)]
    found = out.unionByName(sustained_breaches(calm, calm_rule, seconds_per_period))
    return found.withColumnRenamed("severity", "direction")


def daily_drift(log: DataFrame, features: list[str], time: str = "ts") -> DataFrame:
    """PSI of each day of the current side against the baseline, per feature."""
    long = (
        log.select(F.to_date(time).alias("day"), "side", *features)
        .unpivot(["day", "side"], features, "feature", "value")
        .withColumn("value", F.col("value").cast("double"))
    )
    return psi_by_feature(long, "day")


# Limits of the retraining rules and how many periods in a row they take.
DRIFT_LIMIT, DRIFT_DAYS = 0.2, 3
WEEKLY_RULES = [
    ("false_alarm_rate", 0.10),
    ("missed_leak_rate", 0.05),
    ("avg_detection_delay_minutes", 20.0),
]
WEEKS = 2


def weekly_outcomes(log: DataFrame, time: str = "ts") -> DataFrame:
    """False-alarm rate, missed-leak rate and delay per calendar week."""
    return log.groupBy(F.date_trunc("week", F.col(time)).alias("week")).agg(*measures(OUTCOMES))


def topology_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links present in one network only: (change, columns of the link)."""
    names = before.columns
    gone, new = before.subtract(after), after.subtract(before)
    return gone.select(F.lit("removed").alias("change"), *names).unionByName(
        new.select(F.lit("added").alias("change"), *names)
    )


def retraining_triggers(drift: DataFrame, weekly: DataFrame, schema_change: DataFrame | None = None,
                        topology: DataFrame | None = None) -> DataFrame:
    """Every reason to retrain: (trigger, subject, periods).

    ``drift`` is ``daily_drift``, ``weekly`` is ``weekly_outcomes``; the two
    change tables come from the schema and topology comparisons.
    """
    days = drift.filter(F.col("psi") > DRIFT_LIMIT).withColumn(
        "number", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long")
    )
    long_drift = runs(days, ["feature"], "number", "day").filter(F.col("periods") >= DRIFT_DAYS)
    found = long_drift.select(
        F.lit("drift").alias("trigger"), F.col("feature").alias("subject"), "periods"
    )
    checks = F.array(
        *[
            F.struct(F.lit(metric).alias("metric"), (F.col(metric) > limit).alias("breached"))
            for metric, limit in WEEKLY_RULES
        ]
    )
    weeks = (
        weekly.select("week", F.explode(checks).alias("c"))
        .select("week", "c.*")
        .filter("breached")
        .withColumn(
            "number",
            F.floor(F.datediff(F.to_date("week"), F.lit("1970-01-05").cast("date")) / 7),
        )
    )
    long_weeks = runs(weeks, ["metric"], "number", "week").filter(F.col("periods") >= WEEKS)
    found = found.unionByName(
        long_weeks.select(
            F.lit("outcome").alias("trigger"), F.col("metric").alias("subject"), "periods"
        )
    )
    if schema_change is not None:
        found = found.unionByName(
            schema_change.select(
                F.lit("schema").alias("trigger"),
                F.concat_ws(":", "change", "column_name").alias("subject"),
                F.lit(1).cast("long").alias("periods"),
            )
        )
    if topology is not None:
        sizes = topology.groupBy("change").agg(F.count(F.lit(1)).alias("periods"))
        found = found.unionByName(
            sizes.select(F.lit("topology").alias("trigger"), F.col("change").alias("subject"), "periods")
        )
    return found


def impact_trend(log: DataFrame, time: str = "ts", max_drop: float = 0.15) -> DataFrame:
    """Mean business impact per month, its change and whether it fell too far."""
    monthly = log.groupBy(F.date_trunc("month", F.col(time)).alias("month")).agg(
        F.avg("estimated_business_impact_usd").alias("avg_impact")
    )
    # One row per month.
    before = F.lag("avg_impact").over(Window.orderBy("month"))
    return monthly.withColumn("previous_impact", before).withColumns(
        {
            "change": F.try_divide(F.col("avg_impact") - F.col("previous_impact"), F.col("previous_impact")),
        }
    ).withColumn("degraded", F.coalesce(F.col("change") < -max_drop, F.lit(False)))


def event_latency(df: DataFrame, event_time: str, ingest_time: str, size: str = "1 day",
                  usable_seconds: int = 60) -> DataFrame:
    """Share of events usable in time, per window of event time."""
    delay = (
        F.unix_micros(F.col(ingest_time).cast("timestamp"))
        - F.unix_micros(F.col(event_time).cast("timestamp"))
    ) / F.lit(1e6)
    aggs = [
        F.count(F.lit(1)).alias("events"),
        F.avg(F.when(delay <= usable_seconds, 1.0).otherwise(0.0)).alias("usable_share"),
        F.max(delay).alias("max_delay_seconds"),
    ]
    return windowed(df, size, None, aggs, event_time)
