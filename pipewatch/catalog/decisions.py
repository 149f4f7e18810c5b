"""Decision, approval, gate and economics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog import metrics as mc
from pipewatch.catalog import monitoring as mon
from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import rounded
from pipewatch.operators import decisions as d
from pipewatch.operators import economics as ec
from pipewatch.operators import gates as g
from pipewatch.operators import metrics as m
from pipewatch.operators import monitoring as mo
from pipewatch.operators import splits as sp
from pipewatch.sources.views import table, view

CTES["decision_rows"] = """
    SELECT *, risk >= 0.75 AS is_high, risk >= 0.50 AS material_field_action,
      CASE WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.50 THEN 'medium' ELSE 'low' END AS risk_tier,
      CASE WHEN risk >= 0.75 THEN 'dispatch_field_team' WHEN risk >= 0.50 THEN 'schedule_inspection'
           ELSE 'monitor_and_notify' END AS recommended_action,
      risk >= 0.5 OR conf < 0.6 AS requires_human_approval,
      round_even(risk * 10000.0, 0) / 10000.0 AS risk_score, round_even(conf * 10000.0, 0) / 10000.0 AS confidence
    FROM (SELECT *, 0.45 * leak_probability + 0.35 * anomaly_score + 0.20 * forecast_stress_index AS risk,
            least(0.99, greatest(leak_probability, anomaly_score)) AS conf FROM incident_request)"""
CTES["last_approval"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY approved_at DESC, seq DESC) AS rn
      FROM approval) WHERE rn = 1"""
CTES["status_rows"] = """
    SELECT r.*, coalesce(a.approve, false) AS approved, a.approver_id AS approved_by,
      CASE WHEN material_field_action AND requires_human_approval AND NOT coalesce(a.approve, false)
             THEN 'pending_authorization'
           WHEN material_field_action THEN 'authorized' ELSE 'monitor_only' END AS status
    FROM decision_rows r LEFT JOIN last_approval a ON a.incident_id = r.incident_id"""
CTES["context_rows"] = """
    SELECT incident_id, array_to_string(list_sort(list(DISTINCT asset_id)), ',') AS asset_ids,
      count(*) AS telemetry_points, round(max(pressure), 4) AS max_pressure, round(max(flow), 4) AS max_flow,
      round(avg(demand), 4) AS avg_demand FROM incident_telemetry GROUP BY incident_id"""


def requests(spark, sf):
    return view(spark, sf, "incident_request")


def decided(spark, sf):
    return d.decide(requests(spark, sf))


def status(spark, sf):
    return d.incident_status(decided(spark, sf), view(spark, sf, "approval"))


@query(
    "b20_request_validation",
    """SELECT incident_id, CASE
           WHEN leak_probability > 1 THEN 'leak_probability out of range' ELSE 'anomaly_score missing' END AS reject_reason
       FROM (SELECT concat('N', l_orderkey) AS incident_id, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 0.025 AS leak_probability,
               max(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS anomaly_score FROM lineitem GROUP BY l_orderkey)
       WHERE (leak_probability > 1) <> (anomaly_score IS NULL)
       UNION ALL SELECT incident_id, 'leak_probability out of range; anomaly_score missing'
       FROM (SELECT concat('N', l_orderkey) AS incident_id, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 0.025 AS leak_probability,
               max(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS anomaly_score FROM lineitem GROUP BY l_orderkey)
       WHERE leak_probability > 1 AND anomaly_score IS NULL""",
)
def b20(spark, sf):
    raw = (
        table(spark, sf, "lineitem")
        .groupBy(F.concat(F.lit("N"), "l_orderkey").alias("incident_id"))
        .agg(
            (F.sum(F.round(F.col("l_discount") * 100).cast("long")) * 0.025).alias("leak_probability"),
            F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("anomaly_score"),
            (F.avg("l_quantity") / 50).alias("forecast_stress_index"),
        )
    )
    return d.split_requests(raw)[1].select("incident_id", "reject_reason")


@query("k1_risk_score", "SELECT incident_id, round(risk, 6) AS risk FROM decision_rows")
def k1(spark, sf):
    return rounded(requests(spark, sf).select("incident_id", d.risk_score().alias("risk")))


@query("k2_confidence", "SELECT incident_id, round(conf, 6) AS confidence FROM decision_rows")
def k2(spark, sf):
    return rounded(requests(spark, sf).select("incident_id", d.confidence().alias("confidence")))


@query(
    "k3_tier_action",
    "SELECT incident_id, risk_score, risk_tier, recommended_action, material_field_action FROM decision_rows",
)
def k3(spark, sf):
    return decided(spark, sf).select(
        "incident_id", "risk_score", "risk_tier", "recommended_action", "material_field_action"
    )


@query(
    "k4_approval_need",
    """SELECT incident_id, confidence, requires_human_approval, CASE WHEN requires_human_approval THEN
         'Material action or low-confidence scenario requires operator approval.' END AS approval_reason
       FROM decision_rows""",
)
def k4(spark, sf):
    return decided(spark, sf).select(
        "incident_id", "confidence", "requires_human_approval", "approval_reason"
    )


@query(
    "d33_incident_context",
    "SELECT incident_id, asset_ids, telemetry_points, max_pressure, max_flow, avg_demand FROM context_rows",
)
def d33(spark, sf):
    context = d.incident_context(view(spark, sf, "incident_telemetry"))
    return context.withColumn("asset_ids", F.array_join("asset_ids", ","))


@query(
    "c6_latest_approval",
    "SELECT incident_id, approve AS approved, approver_id AS approved_by, approved_at FROM last_approval",
)
def c6(spark, sf):
    latest = d.latest_approvals(view(spark, sf, "approval"))
    return latest.select("incident_id", "approved", "approved_by", "approved_at")


@query(
    "k5_incident_status",
    """SELECT incident_id, status, approved, approved_by, status = 'authorized' AS material_action_executed,
         status = 'pending_authorization' OR requires_human_approval AS approval_required FROM status_rows""",
)
def k5(spark, sf):
    return status(spark, sf).select(
        "incident_id", "status", "approved", "approved_by", "material_action_executed", "approval_required"
    )


@query(
    "k6_dispatch_plan",
    """SELECT incident_id, target, CASE WHEN target IN ('operations_dashboard', 'field_workflow') THEN 'planned'
         ELSE 'skipped' END AS dispatch_status
       FROM status_rows, (SELECT unnest(['operations_dashboard', 'cmms_work_management', 'field_workflow',
         'customer_service_workflow', 'executive_kpi_reporting']) AS target)
       WHERE status <> 'pending_authorization'""",
)
def k6(spark, sf):
    return d.dispatch_plan(status(spark, sf), ("operations_dashboard", "field_workflow"))


@query(
    "c7_decision_evidence",
    """SELECT incident_id, risk_tier, CASE WHEN material_field_action THEN recommended_action END AS evidence_action
       FROM decision_rows""",
)
def c7(spark, sf):
    decisions = decided(spark, sf)
    found = decisions.filter("material_field_action").select(
        "incident_id", F.col("recommended_action").alias("evidence_action")
    )
    joined = decisions.join(found, "incident_id", "left")
    return joined.select("incident_id", "risk_tier", "evidence_action")


_KPI = """SELECT count(*) AS total_incidents, count(*) FILTER (WHERE material_field_action) AS material_actions,
    round(count(*) FILTER (WHERE approved) / count(*), 4) AS approval_rate,
    count(*) FILTER (WHERE risk_tier = 'high') AS high_risk, count(*) FILTER (WHERE risk_tier = 'medium') AS medium_risk,
    count(*) FILTER (WHERE risk_tier = 'low') AS low_risk FROM status_rows WHERE status <> 'pending_authorization'"""


@query("d34_executive_kpi", _KPI)
def d34(spark, sf):
    return d.executive_kpi(d.outcomes(status(spark, sf)))


@query(
    "f7_priority_ranking",
    """SELECT r.incident_id, risk_score, max_flow, round(risk_score * max_flow, 6) AS priority
       FROM decision_rows r JOIN context_rows c ON c.incident_id = r.incident_id
       ORDER BY risk_score * max_flow DESC, r.incident_id LIMIT 20""",
)
def f7(spark, sf):
    context = d.incident_context(view(spark, sf, "incident_telemetry"))
    joined = decided(spark, sf).join(context.select("incident_id", "max_flow"), "incident_id")
    ranked = d.priority_ranking(joined, "max_flow", 20)
    return rounded(ranked.select("incident_id", "risk_score", "max_flow", "priority"))


# --- gates ---------------------------------------------------------------------------


def gate_sql(subjects: str, metrics: str, rules) -> str:
    """Checks of ``rules`` over CTE text ``metrics`` (subject, metric, value)."""
    rows = ", ".join(
        f"('{c}', '{mt}', '{op}', {bound!r}, {missing!r})" for c, mt, op, bound, missing in rules
    )
    return f"""rules AS (SELECT * FROM (VALUES {rows}) t("check", metric, op, "bound", missing)),
      seen AS ({metrics}),
      checks AS (SELECT s.subject, r."check", r.metric, coalesce(m.value, r.missing) AS value, r.op, r."bound",
          CASE r.op WHEN '>=' THEN coalesce(m.value, r.missing) >= r."bound" WHEN '>' THEN coalesce(m.value, r.missing) > r."bound"
            WHEN '<=' THEN coalesce(m.value, r.missing) <= r."bound" ELSE coalesce(m.value, r.missing) < r."bound" END AS passed
        FROM ({subjects}) s CROSS JOIN rules r LEFT JOIN seen m ON m.subject = s.subject AND m.metric = r.metric)"""


CHECK_OUT = 'SELECT subject, "check", metric, round(CAST(value AS DOUBLE), 6) AS value, op, CAST("bound" AS DOUBLE) AS "bound", passed FROM checks'
VERDICT_OUT = """SELECT subject, bool_and(passed) AS passed, count(*) AS checks,
    count(*) FILTER (WHERE NOT passed) AS failed_checks FROM checks GROUP BY subject"""

_MODEL_METRICS = " UNION ALL ".join(
    f"SELECT model AS subject, '{c}' AS metric, CAST(\"{c}\" AS DOUBLE) AS value FROM model_table"
    for c in ("precision", "recall", "f1", "pr_auc", "business_net_value")
)
_SUFFICIENCY = """SELECT model AS subject, 'real_test_rows' AS metric, CAST((SELECT count(*) FROM real_split
      WHERE split = 'test') AS DOUBLE) AS value FROM model_table
    UNION ALL SELECT model, 'real_test_leaks', CAST((SELECT sum(y) FROM real_split WHERE split = 'test') AS DOUBLE)
      FROM model_table
    UNION ALL SELECT model, 'data_sufficiency_ready', (SELECT CASE WHEN
        count(*) FILTER (WHERE split = 'train' AND _source_type = 'real') >= 200
        AND count(*) FILTER (WHERE split = 'val') >= 30 AND count(*) FILTER (WHERE split = 'test') >= 100
        AND count(*) FILTER (WHERE split = 'test' AND y = 1) >= 10 THEN 1.0 ELSE 0.0 END FROM real_split)
      FROM model_table"""
_ALARMS = """SELECT model AS subject, 'false_alarm_frequency_per_day' AS metric, CASE WHEN fp = 0 THEN 0 ELSE
      fp / greatest((SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 FROM scored), 1) END AS value
    FROM model_table"""


def model_facts(spark, sf):
    """(subject, metric, value) of every model, with the split facts that gate all of them."""
    scores = view(spark, sf, "model_scores")
    instant = F.col("ts").cast("timestamp")
    span = scores.agg(F.min(instant).alias("first"), F.max(instant).alias("last"))
    models = m.model_metrics(scores).withColumns(
        {"_first": span.select("first").scalar(), "_last": span.select("last").scalar()}
    )
    alarms = m.false_alarm_frequency(F.col("fp"), F.col("_first"), F.col("_last"))
    split, _ = sp.temporal_split(mc.scored(spark, sf), mc.time_order(), real_holdout=True)
    ready = sp.data_sufficiency(split, "y").agg(F.bool_and("ok").alias("ready"))
    test = split.filter("split = 'test'").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("leaks")
    )
    return g.long_metrics(
        models.select(
            "model",
            *[F.col(c) for c in ("precision", "recall", "f1", "pr_auc", "business_net_value")],
            alarms.alias("false_alarm_frequency_per_day"),
            test.select("n").scalar().alias("real_test_rows"),
            test.select("leaks").scalar().alias("real_test_leaks"),
            ready.scalar().cast("int").alias("data_sufficiency_ready"),
        ),
        "model",
    )


_ALL_MODEL_FACTS = f"{_MODEL_METRICS} UNION ALL {_SUFFICIENCY} UNION ALL {_ALARMS}"


@query(
    "j14_release_gate",
    f"WITH {gate_sql('SELECT model AS subject FROM model_table', _ALL_MODEL_FACTS, g.RELEASE_GATE)} {CHECK_OUT}",
)
def j14_release(spark, sf):
    return rounded(g.evaluate_gate(model_facts(spark, sf), g.RELEASE_GATE))


@query(
    "j14_release_verdict",
    f"WITH {gate_sql('SELECT model AS subject FROM model_table', _ALL_MODEL_FACTS, g.RELEASE_GATE)} {VERDICT_OUT}",
)
def j14_release_verdict(spark, sf):
    return g.verdict(g.evaluate_gate(model_facts(spark, sf), g.RELEASE_GATE))


# The prose of the release process asks for more than its code.
STRICT = g.with_limits(g.DEPLOYMENT_GATE, precision_ok=0.75, recall_ok=0.80, pr_auc_ok=0.80)


@query(
    "j14_deployment_gate",
    f"WITH {gate_sql('SELECT model AS subject FROM model_table', f'{_MODEL_METRICS} UNION ALL {_ALARMS}', STRICT)} {CHECK_OUT}",
)
def j14_deployment(spark, sf):
    known = model_facts(spark, sf).filter(
        ~F.col("metric").isin("real_test_rows", "real_test_leaks", "data_sufficiency_ready")
    )
    return rounded(g.evaluate_gate(known, STRICT))


_SLO_METRICS = """SELECT 'all' AS subject, 'availability' AS metric, availability AS value FROM report
    UNION ALL SELECT 'all', 'average_latency_ms', average_latency_ms FROM report
    UNION ALL SELECT 'all', 'p95_latency_ms', p95_latency_ms FROM report
    UNION ALL SELECT 'all', 'p99_latency_ms', p99_latency_ms FROM report
    UNION ALL SELECT 'all', 'error_rate', error_rate FROM report
    UNION ALL SELECT 'all', 'success_rate', (SELECT count(*) FILTER (WHERE status_code = 200) / count(*) FROM prediction_log)
    UNION ALL SELECT 'all', 'timeout_rate', (SELECT count(*) FILTER (WHERE status_code IS NULL) / count(*) FROM prediction_log)"""


@query(
    "j14_slo_gate",
    f"""{mon.REPORT_SQL}, {gate_sql("SELECT 'all' AS subject", _SLO_METRICS, g.SLO_GATE)} {CHECK_OUT}""",
)
def j14_slo(spark, sf):
    report = g.long_metrics(mon.report(spark, sf))
    load = mo.request_summary(mon.log(spark, sf)).withColumn(
        "timeout_rate", F.col("timeouts") / F.greatest("requests", F.lit(1))
    )
    facts = report.unionByName(g.long_metrics(load.select("success_rate", "timeout_rate")))
    return rounded(g.evaluate_gate(facts, g.SLO_GATE))


_LOAD_METRICS = f"""SELECT 'all' AS subject, 'success_rate' AS metric,
      count(*) FILTER (WHERE status_code = 200) / count(*) AS value FROM prediction_log
    UNION ALL SELECT 'all', 'latency_ms_p95', {mon._tail(0.95, 'prediction_log')}
    UNION ALL SELECT 'all', 'latency_ms_p99', {mon._tail(0.99, 'prediction_log')}"""


@query(
    "j14_load_gate",
    f"""WITH {gate_sql("SELECT 'all' AS subject", _LOAD_METRICS, g.LOAD_GATE)} {CHECK_OUT}""",
)
def j14_load(spark, sf):
    facts = g.long_metrics(mo.request_summary(mon.log(spark, sf)))
    return rounded(g.evaluate_gate(facts, g.LOAD_GATE))


_DELTA_METRICS = """SELECT 'all' AS subject, 'mean_score_delta' AS metric, avg(delta) AS value FROM blue_green
    UNION ALL SELECT 'all', 'max_score_delta', max(delta) FROM blue_green"""


@query(
    "j14_blue_green_gate",
    f"""WITH {gate_sql("SELECT 'all' AS subject", _DELTA_METRICS, g.BLUE_GREEN_GATE)} {CHECK_OUT}""",
)
def j14_blue_green(spark, sf):
    facts = g.long_metrics(m.delta_summary(mc.blue_green(spark, sf)))
    return rounded(g.evaluate_gate(facts, g.BLUE_GREEN_GATE))


CTES["release_record"] = """
    SELECT o_orderkey, o_orderstatus = 'F' AS approved, o_orderpriority AS approved_by,
      CASE WHEN o_totalprice < 20000 THEN NULL ELSE o_orderdate END AS approved_at,
      CASE WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE concat('CHG-', o_custkey) END AS change_ticket,
      CASE WHEN o_totalprice > 400000 THEN NULL ELSE 'production' END AS scope FROM orders"""


@query(
    "j14_approval_record",
    """SELECT o_orderkey, missing_fields, missing_fields = '' AND coalesce(approved, false) AS passed FROM (
         SELECT *, concat_ws(',', CASE WHEN approved IS NULL THEN 'approved' END,
           CASE WHEN trim(coalesce(approved_by, '')) = '' THEN 'approved_by' END,
           CASE WHEN approved_at IS NULL THEN 'approved_at' END,
           CASE WHEN trim(coalesce(change_ticket, '')) = '' THEN 'change_ticket' END,
           CASE WHEN trim(coalesce(scope, '')) = '' THEN 'scope' END) AS missing_fields FROM release_record)""",
)
def j14_approval(spark, sf):
    price = F.col("o_totalprice")
    records = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("approved"),
        F.col("o_orderpriority").alias("approved_by"),
        F.when(price >= 20000, F.col("o_orderdate")).alias("approved_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  "))
        .otherwise(F.concat(F.lit("CHG-"), "o_custkey"))
        .alias("change_ticket"),
        F.when(price <= 400000, F.lit("production")).alias("scope"),
    )
    return g.approval_record_check(records).select("o_orderkey", "missing_fields", "passed")


@query(
    "c10_gate_join",
    f"""WITH {gate_sql("SELECT 'all' AS subject", _LOAD_METRICS + " UNION ALL " + _DELTA_METRICS,
        g.LOAD_GATE + g.BLUE_GREEN_GATE)} {VERDICT_OUT}""",
)
def c10(spark, sf):
    facts = g.long_metrics(mo.request_summary(mon.log(spark, sf))).unionByName(
        g.long_metrics(m.delta_summary(mc.blue_green(spark, sf)))
    )
    return g.verdict(g.evaluate_gate(facts, g.LOAD_GATE + g.BLUE_GREEN_GATE))


# --- economics -------------------------------------------------------------------------

COST_KIND = {
    "1-URGENT": "incidents",
    "2-HIGH": "predictions",
    "3-MEDIUM": "observations",
    "4-NOT SPECIFIED": "endpoints",
    "5-LOW": "evidence_requests",
}
_KIND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COST_KIND.items())
CTES["cost_rows"] = f"""
    SELECT CASE o_orderpriority {_KIND_SQL} ELSE 'training_runs' END AS usage, o_totalprice AS amount FROM orders"""
CTES["usage_rows"] = """
    SELECT 'endpoints' AS usage, count(DISTINCT user_id) AS quantity FROM events
    UNION ALL SELECT 'observations', count(*) FROM events
    UNION ALL SELECT 'predictions', count(*) FROM prediction_log
    UNION ALL SELECT 'incidents', count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT 'evidence_requests', count(*) FROM benchmark"""


def costs(spark, sf):
    kind = F.coalesce(
        *[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in COST_KIND.items()],
        F.lit("training_runs"),
    )
    return table(spark, sf, "orders").select(kind.alias("usage"), F.col("o_totalprice").alias("amount"))


def usage(spark, sf):
    def one(name, df, count):
        return df.agg(count.cast("long").alias("quantity")).select(F.lit(name).alias("usage"), "quantity")

    rows = F.count(F.lit(1))
    parts = [
        one("endpoints", table(spark, sf, "events"), F.count_distinct("user_id")),
        one("observations", table(spark, sf, "events"), rows),
        one("predictions", mon.log(spark, sf), rows),
        one("incidents", table(spark, sf, "lineitem"), F.count_distinct("l_orderkey")),
        one("evidence_requests", table(spark, sf, "benchmark"), rows),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "k15_unit_economics",
    f"""WITH u AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c!r})" for a, b, c in ec.UNITS)}) t(unit, usage, per))
        SELECT unit, round(coalesce(amount, 0), 2) AS amount, CAST(coalesce(quantity, 0) AS DOUBLE) AS quantity,
          round(amount * CAST(per AS DOUBLE) / nullif(quantity, 0), 2) AS unit_cost
        FROM u LEFT JOIN (SELECT usage, sum(amount) AS amount FROM cost_rows GROUP BY 1) c ON c.usage = u.usage
          LEFT JOIN (SELECT usage, sum(quantity) AS quantity FROM usage_rows GROUP BY 1) q ON q.usage = u.usage""",
)
def k15(spark, sf):
    return rounded(ec.unit_economics(costs(spark, sf), usage(spark, sf)), 2)


@query(
    "k15_benefit_summary",
    """WITH b AS (SELECT sum(l_extendedprice * l_discount) AS g FROM lineitem), c AS (SELECT sum(amount) AS p FROM cost_rows)
       SELECT round(g, 2) AS gross_benefit, round(p, 2) AS platform_cost, round(g - p, 2) AS net_benefit,
         round((g - p) / p, 2) AS roi FROM b, c""",
)
def k15_benefit(spark, sf):
    benefits = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") * F.col("l_discount")).alias("amount")
    )
    return rounded(ec.benefit_summary(benefits, costs(spark, sf)), 2)


@query(
    "k16_decision_kpis",
    """SELECT date_trunc('quarter', o_orderdate) AS quarter, count(*) AS decisions,
         round(avg(CAST(o_orderstatus <> 'P' AS INTEGER)), 6) AS accepted_rate,
         round(avg(CAST(o_orderstatus = 'P' AS INTEGER)), 6) AS overridden_rate,
         round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS approved_rate,
         round(median(o_totalprice / 1000), 6) AS median_triage_minutes FROM orders GROUP BY 1""",
)
def k16(spark, sf):
    state = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(
        F.date_trunc("quarter", "o_orderdate").alias("quarter"),
        (F.col("o_totalprice") / 1000).alias("triage_minutes"),
        (state != "P").alias("accepted"),
        (state == "P").alias("overridden"),
        (state == "F").alias("approved"),
    )
    return rounded(ec.decision_kpis(rows, "quarter"))
