"""Risk, approval and dispatch decisions for incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.functions.expr import half_even

# Request fields, the approval text and the dispatch targets.
SCORES = ("leak_probability", "anomaly_score", "forecast_stress_index")
APPROVAL_REASON = "Material action or low-confidence scenario requires operator approval."
TARGETS = (
    "operations_dashboard",
    "cmms_work_management",
    "field_workflow",
    "customer_service_workflow",
    "executive_kpi_reporting",
)


def reject_reason() -> Column:
    """Why a request is invalid: missing fields, scores outside [0, 1], no telemetry."""
    checks = [F.when(F.col("incident_id").isNull(), F.lit("incident_id missing"))]
    for name in SCORES:
        value = F.col(name)
        checks.append(F.when(value.isNull(), F.lit(f"{name} missing")))
        checks.append(F.when(~value.between(0.0, 1.0), F.lit(f"{name} out of range")))
    return F.nullif(F.concat_ws("; ", *checks), F.lit(""))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the rejected ones with their reason."""
    marked = requests.withColumn("reject_reason", reject_reason())
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )


def risk_score() -> Column:
    return (
        F.lit(0.45) * F.col("leak_probability")
        + F.lit(0.35) * F.col("anomaly_score")
        + F.lit(0.20) * F.col("forecast_stress_index")
    )


def confidence() -> Column:
    return F.least(F.lit(0.99), F.greatest("leak_probability", "anomaly_score"))


def decide(requests: DataFrame) -> DataFrame:
    """Tier, action and approval need; tiers look at the unrounded risk."""
    risk = F.col("_risk")
    high, medium = risk >= 0.75, risk >= 0.50
    needs = (risk >= 0.5) | (F.col("_confidence") < 0.6)
    return (
        requests.withColumns({"_risk": risk_score(), "_confidence": confidence()})
        .withColumns(
            {
                "risk_score": half_even(risk),
                "risk_tier": F.when(high, "high").when(medium, "medium").otherwise("low"),
                "confidence": half_even(F.col("_confidence")),
                "recommended_action": F.when(high, "dispatch_field_team")
                .when(medium, "schedule_inspection")
                .otherwise("monitor_and_notify"),
                "material_field_action": medium,
                "requires_human_approval": needs,
                "approval_reason": F.when(needs, F.lit(APPROVAL_REASON)),
            }
        )
        .drop("_risk", "_confidence")
    )


def incident_context(points: DataFrame) -> DataFrame:
    """Assets and measure summary per incident. Assets are made distinct before they are listed."""
    per_asset = points.groupBy("incident_id", "asset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("pressure").alias("p"),
        F.max("flow").alias("f"),
        F.sum("demand").alias("d"),
        F.count("demand").alias("nd"),
    )
    return per_asset.groupBy("incident_id").agg(
        F.sort_array(F.collect_list("asset_id")).alias("asset_ids"),
        F.sum("n").alias("telemetry_points"),
        half_even(F.max("p")).alias("max_pressure"),
        half_even(F.max("f")).alias("max_flow"),
        half_even(F.sum("d") / F.sum("nd")).alias("avg_demand"),
    )


def latest_approvals(approvals: DataFrame) -> DataFrame:
    """The last approval per incident, by time and then sequence number."""
    last = F.max(F.struct("approved_at", "seq", "approver_id", "approve"))
    return approvals.groupBy("incident_id").agg(last.alias("last")).select(
        "incident_id",
        F.col("last.approve").alias("approved"),
        F.col("last.approver_id").alias("approved_by"),
        F.when(F.col("last.approve"), "approved").otherwise("rejected").alias("approval_status"),
        F.col("last.approved_at").alias("approved_at"),
    )


def incident_status(decisions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Hold material actions that need an approval and have none."""
    joined = decisions.join(latest_approvals(approvals), "incident_id", "left")
    approved = F.coalesce("approved", F.lit(False))
    material = F.col("material_field_action")
    blocked = material & F.col("requires_human_approval") & ~approved
    return joined.withColumns(
        {
            "status": F.when(blocked, "pending_authorization")
            .when(material, "authorized")
            .otherwise("monitor_only"),
            "material_action_executed": material & ~blocked,
            "approval_required": blocked | F.col("requires_human_approval"),
            "approved": approved,
        }
    )


def dispatch_plan(status: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """One row per released incident and target; targets without an address are skipped."""
    released = status.filter("status <> 'pending_authorization'")
    targets = F.array(*[F.lit(t) for t in TARGETS])
    ready = F.col("target").isin(*configured) if configured else F.lit(False)
    return released.select("incident_id", F.explode(targets).alias("target")).withColumn(
        "dispatch_status", F.when(ready, "planned").otherwise("skipped")
    )


def outcomes(status: DataFrame) -> DataFrame:
    """The outcome log: one row per released incident call."""
    return status.filter("status <> 'pending_authorization'").select(
        "incident_id", "risk_tier", "material_field_action", "recommended_action", "approved"
    )


def executive_kpi(outcome_log: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    tiers = [
        F.count_if(F.col("risk_tier") == t).alias(f"{t}_risk") for t in ("high", "medium", "low")
    ]
    return outcome_log.agg(
        n.alias("total_incidents"),
        F.count_if("material_field_action").alias("material_actions"),
        F.coalesce(F.round(F.try_divide(F.count_if("approved"), n), 4), F.lit(0.0)).alias(
            "approval_rate"
        ),
        *tiers,
    )


def priority_ranking(decisions: DataFrame, impact: str, k: int = 20) -> DataFrame:
    """The k incidents with the highest risk times impact."""
    return (
        decisions.withColumn("priority", F.col("risk_score") * F.col(impact))
        .orderBy(F.col("priority").desc(), F.col("incident_id").asc())
        .limit(k)
    )
