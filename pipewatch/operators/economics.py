"""Unit costs, benefit figures and decision-quality KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewatch.operators.ordered import values_at_ranks

# Fixed values: (unit cost, usage it is spread over, units per priced quantity).
UNITS = [
    ("cost_per_endpoint", "endpoints", 1.0),
    ("cost_per_million_observations", "observations", 1e6),
    ("cost_per_1000_predictions", "predictions", 1e3),
    ("cost_per_incident", "incidents", 1.0),
    ("cost_per_evidence_request", "evidence_requests", 1.0),
    ("cost_per_training_run", "training_runs", 1.0),
]


def unit_economics(costs: DataFrame, usage: DataFrame) -> DataFrame:
    """(unit, amount, quantity, unit_cost) from costs (usage, amount) and usage (usage, quantity)."""
    spent = costs.groupBy("usage").agg(F.sum("amount").alias("amount"))
    used = usage.groupBy("usage").agg(F.sum("quantity").alias("quantity"))
    names = F.array(
        *[
            F.struct(F.lit(u).alias("unit"), F.lit(name).alias("usage"), F.lit(per).alias("per"))
            for u, name, per in UNITS
        ]
    )
    units = costs.sparkSession.range(1).select(F.explode(names).alias("u")).select("u.*")
    joined = units.join(spent, "usage", "left").join(used, "usage", "left")
    return joined.select(
        "unit",
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.coalesce("quantity", F.lit(0)).cast("double").alias("quantity"),
        F.try_divide(F.col("amount") * F.col("per"), F.col("quantity")).alias("unit_cost"),
    )


def benefit_summary(benefits: DataFrame, costs: DataFrame) -> DataFrame:
    """Gross benefit, net benefit after platform cost, and return on that cost."""
    gross = benefits.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("gross_benefit"))
    platform = costs.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("platform_cost"))
    net = F.col("gross_benefit") - F.col("platform_cost")
    return gross.withColumn("platform_cost", platform.scalar()).withColumns(
        {"net_benefit": net, "roi": F.try_divide(net, F.col("platform_cost"))}
    )


def decision_kpis(decisions: DataFrame, period: str, minutes: str = "triage_minutes") -> DataFrame:
    """Median detection-to-triage time and acceptance, override and approval rate per period."""
    middle = values_at_ranks(
        decisions,
        minutes,
        {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)},
        (period,),
    ).select(period, ((F.col("low") + F.col("high")) / 2).alias("median_triage_minutes"))
    rates = decisions.groupBy(period).agg(
        F.count(F.lit(1)).alias("decisions"),
        *[
            F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
            for c in ("accepted", "overridden", "approved")
        ],
    )
    return rates.join(middle, period, "left")
