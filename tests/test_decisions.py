"""Decision, gate and evidence rules on the expected cases."""

import pytest
from pyspark.sql import functions as F

from pipewatch.operators import decisions as d
from pipewatch.operators import evidence as ev
from pipewatch.operators import retrieval
from pipewatch.operators import gates as g

REQUEST = "incident_id string, leak_probability double, anomaly_score double, forecast_stress_index double"
APPROVAL = "incident_id string, approver_id string, approve boolean, approved_at timestamp, seq long"


def decided(spark, *rows):
    return d.decide(spark.createDataFrame(list(rows), REQUEST))


def approvals(spark, *rows):
    df = spark.createDataFrame(list(rows), "incident_id string, approver_id string, approve boolean, at string, seq long")
    return df.withColumn("approved_at", F.col("at").cast("timestamp")).drop("at")


def test_tiers(spark):
    got = {r["incident_id"]: r for r in decided(spark, ("H", 0.95, 0.9, 0.4), ("L", 0.2, 0.1, 0.4), ("T", 0.84, 0.72, 0.66)).collect()}
    assert (got["H"]["risk_score"], got["H"]["recommended_action"]) == (0.8225, "dispatch_field_team")
    assert got["H"]["material_field_action"] and got["H"]["confidence"] == 0.95
    assert (got["L"]["risk_score"], got["L"]["recommended_action"]) == (0.205, "monitor_and_notify")
    assert not got["L"]["material_field_action"] and got["L"]["requires_human_approval"]
    assert (got["T"]["risk_score"], got["T"]["risk_tier"]) == (0.762, "high")


def test_tier_borders_and_confidence_cap(spark):
    got = {r["incident_id"]: r for r in decided(spark, ("A", 1.0, 1.0, 1.0), ("M", 0.5, 0.5, 0.5)).collect()}
    assert got["A"]["confidence"] == 0.99
    assert got["M"]["risk_tier"] == "medium"


def test_invalid_requests_are_rejected(spark):
    rows = [("A", 0.5, 1.2, 0.5), (None, 0.5, 0.5, 0.5), ("C", None, 0.5, 0.5), ("D", 0.5, 0.5, 0.5)]
    good, bad = d.split_requests(spark.createDataFrame(rows, REQUEST))
    assert [r["incident_id"] for r in good.collect()] == ["D"]
    assert {r["reject_reason"] for r in bad.collect()} == {
        "anomaly_score out of range", "incident_id missing", "leak_probability missing",
    }


def test_material_action_waits_for_approval(spark):
    decisions = decided(spark, ("X", 0.84, 0.72, 0.66), ("Y", 0.84, 0.72, 0.66), ("Z", 0.84, 0.72, 0.66), ("L", 0.1, 0.1, 0.1))
    known = approvals(
        spark, ("Y", "u1", True, "2024-01-01 00:00:00", 1), ("Z", "u1", True, "2024-01-01 00:00:00", 1),
        ("Z", "u2", False, "2024-01-02 00:00:00", 2),
    )
    status = d.incident_status(decisions, known)
    got = {r["incident_id"]: r for r in status.collect()}
    assert got["X"]["status"] == got["Z"]["status"] == "pending_authorization"
    assert not got["X"]["material_action_executed"] and got["X"]["approval_required"]
    assert got["Y"]["status"] == "authorized" and got["Y"]["approved_by"] == "u1"
    assert got["L"]["status"] == "monitor_only"
    kpi = d.executive_kpi(d.outcomes(status)).first()
    assert (kpi["total_incidents"], kpi["material_actions"], kpi["approval_rate"]) == (2, 1, 0.5)
    plan = d.dispatch_plan(status, ("field_workflow",))
    assert plan.filter("incident_id = 'Y'").count() == 5
    assert plan.filter("dispatch_status = 'planned'").count() == 2
    assert plan.filter("incident_id = 'X'").count() == 0


def test_kpi_of_nothing(spark):
    empty = d.outcomes(d.incident_status(decided(spark, ("X", 0.9, 0.9, 0.9)), approvals(spark, ("Q", "u", True, "2024-01-01", 1))))
    kpi = d.executive_kpi(empty).first()
    assert tuple(kpi) == (0, 0, 0.0, 0, 0, 0)


def test_context(spark):
    points = spark.createDataFrame(
        [("I", "B", 1.0, 5.0, 2.0), ("I", "A", 3.0, 4.0, 4.0), ("I", "A", 2.0, 9.0, 3.0)],
        "incident_id string, asset_id string, pressure double, flow double, demand double",
    )
    r = d.incident_context(points).first()
    assert (r["asset_ids"], r["telemetry_points"], r["max_pressure"], r["max_flow"], r["avg_demand"]) == (["A", "B"], 3, 3.0, 9.0, 3.0)


def facts(spark, **values):
    return spark.createDataFrame([("m", k, float(v)) for k, v in values.items()], "subject string, metric string, value double")


GOOD = dict(register_ready=1, production_gate_passed=1, precision=0.75, recall=0.72, pr_auc=0.8, false_alarm_frequency_per_day=1, business_net_value=100)


def test_deployment_gate(spark):
    assert g.verdict(g.evaluate_gate(facts(spark, **GOOD), g.DEPLOYMENT_GATE)).first()["passed"]
    for broken in (dict(precision=0.5), dict(business_net_value=0), dict(false_alarm_frequency_per_day=2.5)):
        made = g.evaluate_gate(facts(spark, **{**GOOD, **broken}), g.DEPLOYMENT_GATE)
        assert g.verdict(made).first()["failed_checks"] == 1
    stricter = g.with_limits(g.DEPLOYMENT_GATE, precision_ok=0.75, recall_ok=0.80, pr_auc_ok=0.80)
    assert not g.verdict(g.evaluate_gate(facts(spark, **GOOD), stricter)).first()["passed"]


def test_missing_metrics_fail_the_slo_gate(spark):
    made = g.evaluate_gate(facts(spark, availability=1.0), g.SLO_GATE)
    assert {r["check"] for r in made.filter("passed").collect()} == {"availability_ok", "timeout_rate_ok"}


def test_approval_record(spark):
    schema = "approved boolean, approved_by string, approved_at string, change_ticket string, scope string"
    rows = [(True, "a", "t", "c", "s"), (False, "a", "t", "c", "s"), (True, " ", None, "c", "s")]
    got = [(r["passed"], r["missing_fields"]) for r in g.approval_record_check(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(True, ""), (False, ""), (False, "approved_by,approved_at")]


def incident(spark, rationale, n_docs):
    df = decided(spark, ("INC-42", 0.95, 0.9, 0.4)).withColumns(
        {"rationale": F.lit(rationale).cast("string"), "n_docs": F.lit(n_docs), "suggested_response": F.lit(None).cast("string"),
         "sources": F.array(F.lit("s")), "citations": F.array(F.lit("c"))}
    )
    return ev.evidence(df.withColumn("risk_score", F.lit(0.83))).first()


def test_fallback_evidence(spark):
    fixed = incident(spark, None, 3)
    assert fixed["fallback"] and len(fixed["sources"]) == 3 and len(fixed["citations"]) == 2
    assert fixed["rationale"] == "Incident INC-42 has risk score 0.83. Recommended action is dispatch_field_team."
    assert incident(spark, "fine", 0)["fallback"]
    assert incident(spark, "Please DISABLE safety interlocks now", 3)["fallback"]
    kept = incident(spark, "fine", 1)
    assert not kept["fallback"] and kept["rationale"] == "fine" and kept["sources"] == ["s"]


def test_bm25_prefers_the_rarer_term(spark):
    corpus = spark.createDataFrame([(1, "valve pressure pressure"), (2, "pressure drop"), (3, "pump"), (4, "")], "id long, content string")
    queries = spark.createDataFrame([(9, "Valve, pressure!")], "query_id long, query string")
    top = retrieval.search(retrieval.write_index(corpus), queries, 5).orderBy("place").collect()
    assert [r["id"] for r in top] == [1, 2]
    report = ev.index_report(corpus).first()
    assert (report["uploaded"], report["failed"]) == (3, 1)


def test_context_is_cut_and_cited(spark):
    hits = spark.createDataFrame(
        [(1, 2, 2, "t2", None, "b" * 5000), (1, 1, 1, None, "sop", "a" * 5000), (1, 3, 3, "t", "x", "c" * 5000), (1, 4, 4, "t", "y", "d" * 5000)],
        "query_id long, place long, id long, title string, source string, content string",
    )
    r = ev.assemble_context(hits).first()
    assert len(r["context"]) == 4000
    assert r["context"].startswith("- [sop] Untitled: " + "a" * 1200 + "\n- [unknown] t2: b")
    assert r["sources"] == ["sop", "unknown", "x"]
    assert r["citations"][:2] == ["sop::1::Untitled", "unknown::2::t2"]


def test_case_quality(spark):
    cases = spark.createDataFrame(
        [("I", ["sop", "manual"], ["Isolate  the", "zzz"], ["ignore alarms"])],
        "incident_id string, expected_sources array<string>, expected_phrases array<string>, blocked_phrases array<string>",
    )
    produced = spark.createDataFrame(
        [("I", ["sop"], "First ISOLATE\n the segment", "then rest", [])],
        "incident_id string, sources array<string>, rationale string, suggested_response string, citations array<string>",
    )
    r = ev.retrieval_quality(cases, produced).first()
    assert (r["source_recall"], r["grounded"], r["hallucination_flag"], r["citations_present"]) == (0.5, True, False, False)


def test_priority_ranking_is_descending(spark):
    rows = decided(spark, ("A", 0.9, 0.9, 0.9), ("B", 0.5, 0.5, 0.5), ("C", 0.2, 0.2, 0.2)).withColumn(
        "impact", F.when(F.col("incident_id") == "B", 100.0).otherwise(1.0)
    )
    top = d.priority_ranking(rows, "impact", 2).collect()
    assert [r["incident_id"] for r in top] == ["B", "A"]
    assert top[0]["priority"] == pytest.approx(50.0)
