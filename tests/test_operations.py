"""Monitoring, gate, decision and evidence jobs end to end."""

import json

import pytest
from pyspark.sql import functions as F

from pipewatch.operators import gates as g
from pipewatch.plans import operations as op
from pipewatch.sources import schemas


def log_file(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_monitor(spark, tmp_path):
    base = [{"latency_ms": 10.0 * i, "score": i / 20, "confidence": 0.5 + i / 50, "old": 1} for i in range(20)]
    curr = [
        {"latency_ms": 100.0 + i, "score": i / 20, "confidence": 0.5 + i / 50, "status_code": 500 if i == 0 else 200,
         "predicted_label": int(i < 5), "actual_label": int(i < 4), "detection_delay_minutes": 6.0,
         "cpu_percent": None, "estimated_business_impact_usd": 100.0}
        for i in range(20)
    ]
    report = op.monitor(
        spark, log_file(tmp_path, "b.jsonl", base), log_file(tmp_path, "c.jsonl", curr), str(tmp_path / "report")
    )
    r = report.first()
    assert r["average_latency_ms"] == pytest.approx(109.5)
    assert (r["p95_latency_ms"], r["p99_latency_ms"]) == (118.0, 118.0)
    assert (r["error_rate"], r["availability"]) == (0.05, 0.95)
    assert r["false_alarm_rate"] == pytest.approx(1 / 16) and r["missed_leak_rate"] == 0.0
    assert r["prediction_drift_psi"] == pytest.approx(0.0)
    assert r["avg_cpu_percent"] == 0.0
    assert r["removed_columns"] == "old" and "status_code" in r["added_columns"].split(",")
    assert r["missing_rate"] == pytest.approx(20 / 180)
    load = spark.createDataFrame([(300, 300, 0, 1.0)], "requests long, successes long, timeouts long, success_rate double")
    checks = op.slo_gate(report, load)
    assert {x["check"] for x in checks.filter("NOT passed").collect()} == {"availability_ok", "error_rate_ok"}
    with pytest.raises(RuntimeError, match="availability_ok"):
        op.require(checks, "SLO gate")
    assert g.verdict(op.slo_gate(report, load, availability_ok=0.9, error_rate_ok=0.1)).first()["passed"]


def test_deployment_gate_job(spark):
    row = ("rf", True, 0.75, 0.72, 0.8, 1.0, 100.0)
    schema = (
        "model string, register_ready boolean, precision double, recall double, pr_auc double, "
        "false_alarm_frequency_per_day double, business_net_value double"
    )
    good = op.deployment_gate(spark.createDataFrame([row], schema))
    assert g.verdict(good).first()["passed"]
    bad = op.deployment_gate(spark.createDataFrame([("rf", False, *row[2:])], schema))
    assert g.verdict(bad).first()["failed_checks"] == 2


@pytest.fixture
def decided(spark):
    requests = spark.createDataFrame(
        [("INC-1", 0.84, 0.72, 0.66), ("INC-2", 0.1, 0.1, 0.1), ("INC-3", 2.0, 0.1, 0.1), ("INC-4", 0.5, 0.5, 0.5)],
        "incident_id string, leak_probability double, anomaly_score double, forecast_stress_index double",
    )
    points = spark.createDataFrame(
        [("INC-1", "PIPE-1", 50.0, 10.0, 5.0), ("INC-2", "PIPE-2", 51.0, 11.0, 6.0)],
        "incident_id string, asset_id string, pressure double, flow double, demand double",
    )
    approvals = spark.createDataFrame(
        [], "incident_id string, approver_id string, approve boolean, approved_at timestamp, seq long"
    )
    return op.decide_incidents(requests, points, approvals, ("field_workflow",))


def test_decide_incidents(decided):
    reasons = {r["incident_id"]: r["reject_reason"] for r in decided["rejected"].collect()}
    assert reasons == {"INC-3": "leak_probability out of range", "INC-4": "telemetry missing"}
    assert {r["incident_id"]: r["status"] for r in decided["status"].collect()} == {
        "INC-1": "pending_authorization", "INC-2": "monitor_only",
    }
    assert decided["dispatch"].count() == 5
    assert decided["kpi"].first()["total_incidents"] == 1


def test_incident_evidence(spark, decided):
    corpus = spark.createDataFrame(
        [("d1", "Dispatch", "sop", "dispatch field team to the leak"), ("d2", "Pump", "manual", "pump speed")],
        schemas.KNOWLEDGE,
    )
    fixed = op.incident_evidence(decided["decisions"], corpus)
    assert fixed.count() == 2 and fixed.filter("fallback").count() == 2
    generated = spark.createDataFrame(
        [("INC-1", "isolate the segment", "send a crew"), ("INC-2", "ok", "disable safety interlocks")],
        "incident_id string, rationale string, suggested_response string",
    )
    made = {r["incident_id"]: r for r in op.incident_evidence(decided["decisions"], corpus, generated).collect()}
    assert not made["INC-1"]["fallback"] and made["INC-1"]["sources"] == ["sop"]
    assert made["INC-1"]["citations"] == ["sop::d1::Dispatch"]
    assert made["INC-2"]["fallback"]
