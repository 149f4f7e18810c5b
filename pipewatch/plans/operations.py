"""Monitoring, gates, decisions and evidence as jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewatch.operators import decisions as d
from pipewatch.operators import evidence as ev
from pipewatch.operators import gates as g
from pipewatch.operators import monitoring as mo
from pipewatch.operators import retrieval
from pipewatch.sources import readers, writers


def monitor(spark: SparkSession, baseline: str, current: str, output: str) -> DataFrame:
    """Monitoring report of two JSON-lines logs, written as one JSON document and returned."""
    sides = {"baseline": baseline, "current": current}
    logs = [
        readers.read_prediction_log(spark, path).withColumn("side", F.lit(side))
        for side, path in sides.items()
    ]
    report = mo.monitoring_report(
        logs[0].unionByName(logs[1]),
        readers.read_jsonl_maps(spark, baseline),
        readers.read_jsonl_maps(spark, current),
    )
    schema = report.schema
    writers.write_document(report, output)
    return spark.read.schema(schema).json(output)


def slo_gate(report: DataFrame, load: DataFrame, **limits: float) -> DataFrame:
    """SLO checks of a monitoring report and a load-test summary; limits by check name."""
    calls = load.withColumn(
        "timeout_rate", F.col("timeouts") / F.greatest(F.col("requests"), F.lit(1))
    )
    facts = g.long_metrics(report).unionByName(
        g.long_metrics(calls.select("success_rate", "timeout_rate"))
    )
    return g.evaluate_gate(facts, g.with_limits(g.SLO_GATE, **limits))


def deployment_gate(candidate: DataFrame, **limits: float) -> DataFrame:
    """Deployment checks of a candidate row as ``select_candidate`` leaves it."""
    ready = F.col("register_ready").cast("int")
    facts = g.long_metrics(
        candidate.drop("threshold").withColumns(
            {"register_ready": ready, "production_gate_passed": ready}
        ),
        "model",
    )
    return g.evaluate_gate(facts, g.with_limits(g.DEPLOYMENT_GATE, **limits))


def require(checks: DataFrame, what: str) -> None:
    """Stop the job when a check does not hold, or when nothing was checked."""
    if checks.isEmpty():
        raise RuntimeError(f"{what} failed: nothing was checked")
    failed = [r["check"] for r in checks.filter(~F.col("passed")).select("check").distinct().collect()]
    if failed:
        raise RuntimeError(f"{what} failed: {sorted(failed)}")


def decide_incidents(requests: DataFrame, points: DataFrame, approvals: DataFrame,
                     configured: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Requests to decisions, status, dispatch plan, outcome log and KPI.

    ``points`` are the telemetry points of the requests; a request without any
    has no context and is rejected with the invalid ones.
    """
    valid, rejected = d.split_requests(requests)
    context = d.incident_context(points)
    bare = valid.join(context, "incident_id", "left_anti").withColumn(
        "reject_reason", F.lit("telemetry missing")
    )
    decisions = d.decide(valid).join(context, "incident_id")
    status = d.incident_status(decisions, approvals)
    outcome_log = d.outcomes(status)
    return {
        "rejected": rejected.unionByName(bare),
        "decisions": decisions,
        "status": status,
        "dispatch": d.dispatch_plan(status, configured),
        "outcomes": outcome_log,
        "kpi": d.executive_kpi(outcome_log),
    }


def incident_evidence(decisions: DataFrame, corpus: DataFrame, generated: DataFrame | None = None,
                      k: int = 5, min_docs: int = 1,
                      terms: tuple[str, ...] = ev.BLOCKLIST, index: retrieval.SearchIndex | None = None) -> DataFrame:
    """Evidence per decided incident from the k best documents of the corpus, found in its stored ``index``.

    ``generated`` (incident_id, rationale, suggested_response) comes from a text
    service; without it every incident gets the fixed evidence.
    """
    text = ev.incident_query(F.col("incident_id"), F.col("recommended_action"), F.col("asset_ids"))
    queries = decisions.select("incident_id", text.alias("query"))
    asked, top = retrieval.answers(index or retrieval.write_index(corpus), queries, k, qid="incident_id")
    # Incidents of the same ask share a context, which is put together once; texts travel no longer than they are shown.
    shown = corpus.withColumn("content", F.left("content", F.lit(ev.SNIPPET_CHARS)))
    context = ev.assemble_context(top.join(shown, "id"), qid="_ask")
    found = (
        decisions.join(asked, "incident_id", "left")
        .join(context.select("_ask", "context", "sources", "citations", "n_docs"), "_ask", "left")
        .drop("_ask")
        .withColumn("context", F.coalesce("context", F.lit(ev.NO_CONTEXT)))
    )
    if generated is None:
        nothing = F.lit(None).cast("string")
        found = found.withColumns({"rationale": nothing, "suggested_response": nothing})
    else:
        found = found.join(generated, "incident_id", "left")
    return ev.evidence(found, min_docs, terms)
