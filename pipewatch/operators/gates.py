"""Release gates: metrics checked against rules held as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (check, metric, comparison, limit, value assumed when the metric is missing).
RELEASE_GATE = [
    ("real_test_rows_ok", "real_test_rows", ">=", 100.0, 0.0),
    ("real_test_leaks_ok", "real_test_leaks", ">=", 10.0, 0.0),
    ("precision_ok", "precision", ">=", 0.6, 0.0),
    ("recall_ok", "recall", ">=", 0.6, 0.0),
    ("pr_auc_ok", "pr_auc", ">=", 0.6, 0.0),
    ("false_alarm_freq_ok", "false_alarm_frequency_per_day", "<=", 2.0, 1e9),
    ("net_value_ok", "business_net_value", ">", 0.0, -1e9),
    ("data_sufficiency_ok", "data_sufficiency_ready", ">=", 1.0, 0.0),
]
DEPLOYMENT_GATE = [
    ("register_ready", "register_ready", ">=", 1.0, 0.0),
    ("production_gate_passed", "production_gate_passed", ">=", 1.0, 0.0),
    ("precision_ok", "precision", ">=", 0.6, 0.0),
    ("recall_ok", "recall", ">=", 0.6, 0.0),
    ("pr_auc_ok", "pr_auc", ">=", 0.6, 0.0),
    ("false_alarm_ok", "false_alarm_frequency_per_day", "<=", 2.0, 1e9),
    ("net_value_ok", "business_net_value", ">", 0.0, -1e9),
]
SLO_GATE = [
    ("availability_ok", "availability", ">=", 0.995, 0.0),
    ("avg_latency_ok", "average_latency_ms", "<=", 350.0, 1e9),
    ("p95_latency_ok", "p95_latency_ms", "<=", 1000.0, 1e9),
    ("p99_latency_ok", "p99_latency_ms", "<=", 1500.0, 1e9),
    ("error_rate_ok", "error_rate", "<=", 0.01, 1.0),
    ("load_success_ok", "success_rate", ">=", 0.99, 0.0),
    ("timeout_rate_ok", "timeout_rate", "<=", 0.10, 0.0),
]
LOAD_GATE = [
    ("success_rate_ok", "success_rate", ">=", 0.99, 0.0),
    ("p95_ok", "latency_ms_p95", "<=", 1000.0, 1e9),
    ("p99_ok", "latency_ms_p99", "<=", 1500.0, 1e9),
]
BLUE_GREEN_GATE = [
    ("mean_delta_ok", "mean_score_delta", "<=", 0.08, 1e9),
    ("max_delta_ok", "max_score_delta", "<=", 0.20, 1e9),
]
APPROVAL_FIELDS = ("approved", "approved_by", "approved_at", "change_ticket", "scope")

RULE_FIELDS = ("check", "metric", "op", "bound", "missing")


def with_limits(rules: list[tuple], **limits: float) -> list[tuple]:
    """The rules with other limits for the named checks."""
    return [(c, m, op, limits.get(c, limit), default) for c, m, op, limit, default in rules]


def long_metrics(wide: DataFrame, subject: str | None = None) -> DataFrame:
    """(subject, metric, value) rows of a table with a column per metric."""
    names = [n for n, t in wide.dtypes if n != subject and t not in ("string", "timestamp")]
    who = F.col(subject) if subject else F.lit("all")
    columns = [F.col(n).cast("double").alias(n) for n in names]
    return wide.select(who.alias("subject"), *columns).unpivot("subject", names, "metric", "value")


def holds(op: Column, value: Column, bound: Column) -> Column:
    return (
        F.when(op == ">=", value >= bound)
        .when(op == ">", value > bound)
        .when(op == "<=", value <= bound)
        .when(op == "<", value < bound)
    )


def evaluate_gate(metrics: DataFrame, rules: list[tuple], expected: tuple[str, ...] = ()) -> DataFrame:
    """Every rule for every subject, with the value it saw and whether it holds.

    Subjects named in ``expected`` are checked even if ``metrics`` has no row of them.
    """
    entries = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(RULE_FIELDS, rule)]) for rule in rules]
    )
    subjects = metrics.select("subject")
    if expected:
        named = metrics.sparkSession.createDataFrame([(s,) for s in expected], "subject string")
        subjects = subjects.unionByName(named)
    subjects = subjects.distinct()
    wanted = subjects.select("subject", F.explode(entries).alias("r")).select("subject", "r.*")
    seen = wanted.join(metrics, ["subject", "metric"], "left")
    value = F.coalesce("value", "missing")
    return seen.select(
        "subject",
        "check",
        "metric",
        value.alias("value"),
        "op",
        "bound",
        F.coalesce(holds(F.col("op"), value, F.col("bound")), F.lit(False)).alias("passed"),
    )


def verdict(checks: DataFrame) -> DataFrame:
    return checks.groupBy("subject").agg(
        F.bool_and("passed").alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
    )


def approval_record_check(records: DataFrame) -> DataFrame:
    """Whether a release approval is complete and given; text fields may not be blank."""
    blank = {
        f: F.col(f).isNull()
        if f == "approved"
        else F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True))
        for f in APPROVAL_FIELDS
    }
    missing = F.concat_ws(",", *[F.when(blank[f], F.lit(f)) for f in APPROVAL_FIELDS])
    return records.withColumn("missing_fields", missing).withColumn(
        "passed", (F.col("missing_fields") == "") & F.coalesce("approved", F.lit(False))
    )
