"""Training-frame, inference-check, scenario and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog.medallion import gold_frame
from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import rounded
from pipewatch.operators import inference as inf
from pipewatch.operators import scenarios as sc
from pipewatch.operators.silver import event_time
from pipewatch.sources.schemas import MODEL_FEATURES
from pipewatch.sources.views import table, telemetry

FEATURES = list(MODEL_FEATURES)


def r6(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "b17_training_frame",
    f"SELECT {r6(FEATURES)}, leak_label FROM gold_rows",
)
def b17(spark, sf):
    return rounded(inf.training_frame(gold_frame(spark, sf)))


@query(
    "b18_finite_values",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 7 = 1 OR event_id % 7 = 2 THEN 0 ELSE value END AS value,
         CASE WHEN event_id % 11 = 0 THEN 0 ELSE value * 2 END AS flow FROM events""",
)
def b18(spark, sf):
    k = F.col("event_id") % 7
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(k == 0, F.lit(float("inf")))
        .when(k == 1, F.lit(float("-inf")))
        .when(k == 2, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("value") * 2).alias("flow"),
    )
    return inf.clean_non_finite(rows, ["value", "flow"])


def payload_rows(spark, sf):
    """Scoring requests as JSON: objects and lists, some of them broken."""
    i = F.col("event_id")
    numbers = [F.round(F.col("value") * (k + 1), 2).cast("string") for k in range(len(FEATURES))]
    parts = []
    for name, number in zip(FEATURES, numbers):
        field = F.concat(F.lit(f'"{name}": '), number)
        if name == "pressure":
            field = F.when(i % 79 == 0, F.lit('"pressure": null')).otherwise(field)
        if name == "flow":
            field = F.when(i % 97 == 0, F.lit(None)).when(i % 89 == 0, '"flow": "abc"').otherwise(field)
        if name == "demand":
            field = F.when(i % 83 == 0, F.lit('"demand": "NaN"')).otherwise(field)
        parts.append(field)
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    short = F.when(i % 71 != 0, numbers[-1])
    listed = F.concat(F.lit("["), F.concat_ws(", ", *numbers[:-1], short), F.lit("]"))
    text = F.when(i % 73 == 0, F.lit('"loose text"')).when(i % 5 == 0, listed).otherwise(whole)
    return table(spark, sf, "events").select(
        F.floor(i / 20).alias("batch_id"), i.alias("row_index"), text.alias("payload")
    )


CTES["payload_errors"] = """
    SELECT event_id // 20 AS batch_id, event_id AS row_index, value, CASE
      WHEN event_id % 73 = 0 THEN concat('Row ', event_id, ' must be an object or list')
      WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 71 = 0 THEN concat('Row ', event_id, ' must contain 11 feature values') END
      WHEN event_id % 97 = 0 THEN concat('Row ', event_id, ' missing fields: [''flow'']')
      WHEN event_id % 89 = 0 OR event_id % 79 = 0 THEN concat('Row ', event_id, ' contains non-numeric feature values')
      WHEN event_id % 83 = 0 THEN concat('Row ', event_id, ' contains NaN or infinite values') END AS error
    FROM events"""
CTES["payload_batches"] = """
    SELECT batch_id, count(*) AS n_rows, count(error) AS n_errors, count(*) > 10000 AS too_long,
      count(*) <= 10000 AND count(error) = 0 AS accepted FROM payload_errors GROUP BY batch_id"""


@query(
    "b19_inference_rows",
    "SELECT batch_id, row_index, error, CASE WHEN error IS NULL THEN round(value, 2) END AS first_value FROM payload_errors",
)
def b19(spark, sf):
    checked = inf.validate_rows(payload_rows(spark, sf))
    return checked.select("batch_id", "row_index", "error", F.col("values")[0].alias("first_value"))


@query("b19_inference_batches", "SELECT batch_id, n_rows, n_errors, too_long, accepted FROM payload_batches")
def b19_batches(spark, sf):
    return inf.batch_verdicts(inf.validate_rows(payload_rows(spark, sf)))


# --- scenarios -----------------------------------------------------------------------


def _u(seed: str, *ids: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"(CAST(CAST(concat('0x', substr(md5(concat_ws(':', {text})), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def _z(seed: str, *ids: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {_u(seed + 'a', *ids)})) * cos(2.0 * pi() * {_u(seed + 'b', *ids)}))"


CTES["gold_ranked"] = """
    SELECT *, row_number() OVER (ORDER BY event_ts_utc, sensor_node_id) - 1 AS place FROM gold_rows"""
CTES["stress_base"] = f"""
    SELECT d.id AS sample_id, sensor_node_id, leak_label,
      {", ".join(f"{f} + 0.03 * {_z('42:' + f, 'd.id')} AS {f}" for f in FEATURES)}
    FROM range(300) d(id) JOIN gold_ranked g
      ON g.place = CAST(floor({_u('42', 'd.id')} * (SELECT count(*) FROM gold_rows)) AS BIGINT)"""
_hit = f"{_u('42:mask', 'scenario', 'sample_id')}"


def _masked(which: int) -> str:
    """CASE over the masked scenarios giving the factor of one measure."""
    arms = " ".join(
        f"WHEN scenario = '{s[0]}' AND {_hit} < {s[1]!r} THEN {s[2 + which]!r}" for s in sc.MASKED
    )
    extra = ""
    if which < 2:
        factor = ("4.5", "4.0")[which]
        extra = f"WHEN scenario = 'extreme_values' AND extreme < greatest(1, floor(0.05 * n)) THEN {factor} "
    if which == 0:
        extra += f"WHEN scenario = 'pressure_variation' THEN 1.0 + 0.12 * {_z('42:pressure_variation', 'sample_id')} "
    return f"CASE {extra}{arms} ELSE 1.0 END"


def _measure(m: str, which: int) -> str:
    noise = f"0.18 * greatest(1e-6, std_{m}) * {_z('42:sensor_noise:' + m, 'sample_id')}"
    return f"""CASE WHEN scenario = 'missing_sensors' AND {_u('42:missing:' + m, 'sample_id')} < 0.25 THEN NULL
        ELSE {m} * {_masked(which)} + CASE WHEN scenario = 'sensor_noise' THEN {noise} ELSE 0 END END AS {m}"""


CTES["scenario_rows"] = f"""
    SELECT sample_id, scenario, CASE WHEN scenario = 'different_leak_locations'
        THEN concat('N', CAST(floor({_u('42:location', 'sample_id')} * 4) AS BIGINT) + 1) ELSE sensor_node_id END AS sensor_node_id,
      CASE {" ".join(f"WHEN scenario = '{s[0]}' AND {_hit} < {s[1]!r} THEN 1" for s in sc.MASKED if s[5])}
        ELSE leak_label END AS leak_label,
      {", ".join(_measure(m, i) for i, m in enumerate(sc.MEASURES))},
      {", ".join(f for f in FEATURES if f not in sc.MEASURES)}
    FROM (SELECT *, row_number() OVER (ORDER BY {_u('42:extreme_values', 'sample_id')}, sample_id) - 1 AS extreme FROM stress_base),
      (SELECT count(*) AS n, {", ".join(f"stddev_samp({m}) AS std_{m}" for m in sc.MEASURES)} FROM stress_base),
      (SELECT unnest({sc.SCENARIOS!r}) AS scenario)
    WHERE scenario <> 'partial_telemetry' OR {_u('42:partial', 'sample_id')} > 0.3"""
# A stand-in score that rises with flow and falls with pressure.
_SCORE_SQL = "round(least(1.0, greatest(0.0, coalesce(flow, 0) / (coalesce(flow, 0) + 4 * coalesce(pressure, 0) + 50.0))), 6)"
CTES["scenario_results"] = f"""
    SELECT scenario, n_rows, CASE WHEN ok THEN mean_score END AS mean_score, CASE WHEN ok THEN p END AS "precision",
      CASE WHEN ok THEN r END AS recall, CASE WHEN ok THEN 2 * p * r / greatest(p + r, 1e-9) END AS f1,
      CASE WHEN ok THEN positive END AS predicted_positive_rate, CASE WHEN ok THEN 'ok' ELSE 'handled' END AS status
    FROM (SELECT scenario, scenario <> 'malformed_inputs' AS ok, count(*) AS n_rows, avg(score) AS mean_score,
        count(*) FILTER (WHERE leak_label = 1 AND score >= 0.5) / greatest(count(*) FILTER (WHERE score >= 0.5), 1) AS p,
        count(*) FILTER (WHERE leak_label = 1 AND score >= 0.5) / greatest(count(*) FILTER (WHERE leak_label = 1), 1) AS r,
        avg(CAST(score >= 0.5 AS INTEGER)) AS positive
      FROM (SELECT *, {_SCORE_SQL} AS score FROM scenario_rows) GROUP BY scenario)"""


def gold_order():
    return [F.col("event_ts_utc"), F.col("sensor_node_id")]


def base(spark, sf):
    keep = ["event_ts_utc", "sensor_node_id", "leak_label", *FEATURES]
    return sc.stress_baseline(gold_frame(spark, sf).select(*keep), FEATURES, gold_order())


def frames(spark, sf):
    return sc.scenario_frames(base(spark, sf))


def scored_frames(spark, sf):
    clean = sc.scenario_features(frames(spark, sf), FEATURES)
    flow, pressure = F.col("flow"), F.col("pressure")
    share = flow / (flow + 4 * pressure + 50.0)
    return clean.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), 6))


@query(
    "j11_stress_baseline",
    f"SELECT sample_id, sensor_node_id, leak_label, {r6(FEATURES)} FROM stress_base",
)
def j11(spark, sf):
    return rounded(base(spark, sf).drop("event_ts_utc"))


@query(
    "j12_stress_scenarios",
    f"SELECT sample_id, scenario, sensor_node_id, leak_label, {r6(sc.MEASURES)} FROM scenario_rows",
)
def j12(spark, sf):
    return rounded(
        frames(spark, sf).select("sample_id", "scenario", "sensor_node_id", "leak_label", *sc.MEASURES)
    )


@query(
    "j13_formula_results",
    f"""SELECT scenario, n_rows, status, {", ".join(f'round("{c}", 6) AS "{c}"' for c in
        ("mean_score", "precision", "recall", "f1", "predicted_positive_rate"))} FROM scenario_results""",
)
def j13_formula(spark, sf):
    """The evaluation over scores any engine can repeat; ``j13_scenario_results`` scores with a model."""
    return rounded(sc.evaluate_scenarios(scored_frames(spark, sf)))


@query(
    "d39_formula_generalization",
    f"""SELECT count(f1) AS scenarios, round(avg(f1), 6) AS mean_f1, round(min(f1), 6) AS min_f1 FROM scenario_results
        WHERE scenario IN ({", ".join(f"'{s}'" for s in sc.GENERALIZATION)})""",
)
def d39_formula(spark, sf):
    return rounded(sc.generalization(sc.evaluate_scenarios(scored_frames(spark, sf))))


# --- augmentation -----------------------------------------------------------------------

CTES["seed_rows"] = """
    SELECT event_id, TRY_CAST(reading_time AS TIMESTAMP) AS "timestamp", node_id, pressure, flow, demand, leak_label,
      row_number() OVER (ORDER BY event_id) - 1 AS place FROM telemetry_raw
    WHERE TRY_CAST(reading_time AS TIMESTAMP) IS NOT NULL"""


def augmented_sql(multiplier: int) -> str:
    def noisy(m: str, scale: float) -> str:
        return f"greatest({m} * (1.0 + {scale!r} * {_z('42:' + m, 'sample_id')}), 0.0)"

    def leak(value: str, name: str, low: float, high: float) -> str:
        factor = f"({low!r} + {high - low!r} * {_u('42:leak:' + name, 'sample_id')})"
        return f"CASE WHEN new_label = 1 AND {name} IS NOT NULL THEN greatest({value} * {factor}, 0.0) WHEN {name} IS NOT NULL THEN {value} END"

    def measure(name: str, scale: float, bounds: tuple[float, float] | None) -> str:
        value = noisy(name, scale)
        inner = leak(value, name, *bounds) if bounds else f"CASE WHEN {name} IS NOT NULL THEN {value} END"
        return f"{inner} AS {name}"

    return f"""
      SELECT sample_id, "timestamp" + CAST(floor({_u('42:minutes', 'sample_id')} * 11) - 5 AS INTEGER) * INTERVAL 1 MINUTE AS "timestamp",
        node_id, new_label AS leak_label, {measure('pressure', 0.04, (0.75, 0.95))}, {measure('flow', 0.06, (1.05, 1.35))},
        {measure('demand', 0.06, None)}
      FROM (SELECT d.id AS sample_id, s.*, CASE WHEN {_u('42:label', 'd.id')} < (SELECT least(avg(leak_label) * 1.2, 0.35) FROM seed_rows)
            THEN 1 ELSE 0 END AS new_label
          FROM (SELECT id, CAST(floor({_u('42', 'id')} * n) AS BIGINT) AS place FROM
              (SELECT count(*) AS n, unnest(range(count(*) * {multiplier})) AS id FROM seed_rows)) d
            JOIN seed_rows s ON s.place = d.place)"""


def seeds(spark, sf):
    rows = telemetry(spark, sf).withColumn("timestamp", event_time("timestamp"))
    keep = ["event_id", "timestamp", "node_id", "pressure", "flow", "demand", "leak_label"]
    return rows.select(*keep).dropna(subset=["timestamp"])


@query(
    "j17_synthetic_readings",
    f"""SELECT sample_id, "timestamp", node_id, leak_label, {r6(sc.MEASURES)} FROM ({augmented_sql(40)})""",
)
def j17(spark, sf):
    rows = sc.augment(seeds(spark, sf), [F.col("event_id")])
    return rounded(rows.drop("event_id"))


@query(
    "d43_augmentation_summary",
    f"""SELECT count(*) AS synthetic_rows, round(avg(leak_label), 6) AS synthetic_leak_rate,
          (SELECT count(*) FROM seed_rows) AS seed_rows, (SELECT round(avg(leak_label), 6) FROM seed_rows) AS seed_leak_rate
        FROM ({augmented_sql(40)})""",
)
def d43(spark, sf):
    rows = seeds(spark, sf)
    return rounded(sc.augmentation_summary(rows, sc.augment(rows, [F.col("event_id")])))
