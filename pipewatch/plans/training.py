"""Model suite, stress test, candidate choice and scoring."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewatch.operators import gates as g
from pipewatch.operators import inference as inf
from pipewatch.operators import isolation as iso
from pipewatch.operators import metrics as m
from pipewatch.operators import models as mm
from pipewatch.operators import scenarios as sc
from pipewatch.operators import splits as sp
from pipewatch.operators.gold import FEATURE_DICTIONARY
from pipewatch.sources.scratch import checkpointed

LABEL = "target_leak_horizon"
ORDER = ["event_ts_utc", "sensor_node_id"]


def order_columns():
    return [F.col(c) for c in ORDER]


@dataclass
class Fitted:
    """A trained model: how it scores a frame, or why it was skipped.

    ``score(df, by)`` scales scores that need it within each group of ``by``. ``model`` and
    ``scaler`` are what the score is made of, for ``plans.store``.
    """

    name: str
    features: list[str]
    score: Callable[..., DataFrame] | None
    reason: str | None = None
    model: object = None
    scaler: dict[str, tuple[float, float]] | None = None


def fit_isolation(train: DataFrame, features: list[str], n_trees: int = 300) -> Fitted:
    """Isolation forest on the normal rows of the scaled train split."""
    scaler = mm.fit_scaler(train, features)
    scaled = mm.apply_scaler(train, scaler)
    normal = scaled.filter(F.col(LABEL) == 0)
    rows = normal if normal.limit(2).count() >= 2 else scaled
    return anomaly_model(iso.fit_isolation_forest(rows, features, order_columns(), n_trees), scaler)


def anomaly_model(forest: iso.IsolationForest, scaler: dict[str, tuple[float, float]]) -> Fitted:
    """A grown forest over scaled features, ready to score."""
    features = forest.features

    def score(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        kept = [c for c in df.columns if c not in features]
        scored = iso.scaled_scores(mm.apply_scaler(df, scaler), forest, by)
        return scored.select(*kept, "score")

    return Fitted("isolation_forest", features, score, model=forest, scaler=scaler)


def supervised(name: str, train: DataFrame, features: list[str], fit) -> Fitted:
    if not mm.is_trainable(train, LABEL):
        return Fitted(name, features, None, mm.SINGLE_CLASS)
    return probability_model(name, features, fit(train, features, LABEL))


def probability_model(name: str, features: list[str], model) -> Fitted:
    """A fitted classifier, ready to score."""

    def score(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        kept = [c for c in df.columns if c not in features]
        return mm.score_with(model, df, features).select(*kept, "score")

    return Fitted(name, features, score, model=model)


@dataclass
class Suite:
    """What a training run leaves: tables, and the models for scoring."""

    run_id: str
    split: DataFrame
    policy: str
    scored: DataFrame
    metrics: DataFrame
    sweeps: DataFrame
    best_thresholds: DataFrame
    calibration: DataFrame
    reports: DataFrame
    skipped: DataFrame
    sufficiency: DataFrame
    profile: DataFrame
    complexity: DataFrame
    gate: DataFrame
    models: dict[str, Fitted]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train_suite(
    gold: DataFrame,
    train_frac: float = 0.6,
    val_frac: float = 0.2,
    threshold: float = 0.5,
    cost_missed_leak: float = m.COST_MISSED_LEAK,
    cost_false_alarm: float = m.COST_FALSE_ALARM,
    value_early_detection: float = m.VALUE_EARLY_DETECTION,
    real_holdout: bool = False,
    enforce_data_sufficiency: bool = False,
    enforce_production_gate: bool = False,
    minimums: dict[str, int] = sp.MINIMUMS,
    isolation_trees: int = 300,
    forest_trees: int = 400,
    boosting_rounds: int = 300,
) -> Suite:
    """Split in time, fit three models, evaluate them and apply the release gate."""
    features = mm.candidate_features(gold)
    leaking = mm.leaking_features(features)
    if leaking:
        raise ValueError(f"Potential feature leakage columns detected: {leaking}")
    keep = list(dict.fromkeys([*ORDER, LABEL, "_source_type", *features]))
    split, policy = sp.temporal_split(
        checkpointed(gold.select(*keep)), order_columns(), train_frac, val_frac, real_holdout
    )
    train, held = split.filter("split = 'train'"), split.filter("split <> 'train'")

    fits = {
        "isolation_forest": lambda: fit_isolation(train, features, isolation_trees),
        "random_forest": lambda: supervised(
            "random_forest", train, features,
            lambda t, f, y: mm.fit_random_forest(t, f, y, forest_trees),
        ),
        "boosted_trees": lambda: supervised(
            "boosted_trees", train, features,
            lambda t, f, y: mm.fit_boosted_trees(t, f, y, boosting_rounds),
        ),
    }
    models = {name: fit() for name, fit in fits.items()}
    trained = [f for f in models.values() if f.score]
    scored = checkpointed(
        _union([f.score(held).withColumn("model", F.lit(f.name)) for f in trained])
        .withColumn("y", F.col(LABEL).cast("int"))
    )
    costs = {
        "missed": cost_missed_leak, "alarm": cost_false_alarm, "early": value_early_detection,
        "time": "event_ts_utc",
    }

    def part(model: str, which: str) -> DataFrame:
        return scored.filter((F.col("model") == model) & (F.col("split") == which))

    def tagged(df: DataFrame, model: str, which: str) -> DataFrame:
        return df.select(F.lit(model).alias("model"), F.lit(which).alias("split"), "*")

    names = [f.name for f in trained]
    both = [(n, w) for n in names for w in (sp.VAL, sp.TEST)]
    metrics = checkpointed(
        _union([tagged(m.evaluate(part(n, w), ORDER, threshold, **costs), n, w) for n, w in both])
    )
    sweeps = checkpointed(_union([tagged(m.sweep(part(n, sp.VAL), ORDER, **costs), n, sp.VAL) for n in names]))
    best = _union([m.best_threshold(sweeps.filter(F.col("model") == n)) for n in names])
    calibration = _union(
        [
            tagged(
                m.brier_score(part(n, sp.TEST)).withColumn(
                    "expected_calibration_error",
                    m.calibration_error(m.calibration_curve(part(n, sp.TEST))).scalar(),
                ),
                n, sp.TEST,
            )
            for n in names
        ]
    )
    reports = m.classification_report(m.confusion(scored, threshold, ("model", "split")))
    spark = gold.sparkSession
    skipped = spark.createDataFrame(
        [(f.name, f.reason) for f in models.values() if f.reason], "model string, reason string"
    )
    sufficiency = checkpointed(sp.data_sufficiency(split, LABEL, minimums=minimums))
    facts = release_facts(metrics.filter("split = 'test'"), sufficiency)
    rules = g.with_limits(
        g.RELEASE_GATE,
        real_test_rows_ok=float(minimums["real_test_rows"]),
        real_test_leaks_ok=float(minimums["real_test_leaks"]),
    )
    gate = checkpointed(g.evaluate_gate(facts, rules))
    suite = Suite(
        uuid.uuid4().hex, split, policy, scored, metrics, sweeps, best, calibration, reports,
        skipped, sufficiency, sp.split_profile(split, LABEL),
        m.complexity_rules(gold, len(features)), gate, models,
    )
    if enforce_data_sufficiency and not sufficiency.first()["ready"]:
        raise RuntimeError("data sufficiency failed: see the sufficiency table")
    if enforce_production_gate:
        chosen = m.select_candidate(metrics.filter("split = 'test'")).first()["model"]
        if not g.verdict(gate).filter(F.col("subject") == chosen).first()["passed"]:
            raise RuntimeError("release gate failed: see the gate table")
    return suite


def release_facts(test_metrics: DataFrame, sufficiency: DataFrame) -> DataFrame:
    """Long metrics the release gate looks at, per model."""
    actual = sufficiency.agg(
        *[
            F.max(F.when(F.col("requirement") == n, F.col("actual"))).alias(n)
            for n in ("real_test_rows", "real_test_leaks")
        ],
        F.bool_and("ready").cast("int").alias("data_sufficiency_ready"),
    )
    columns = ["real_test_rows", "real_test_leaks", "data_sufficiency_ready"]
    return g.long_metrics(
        test_metrics.drop("split", "threshold").withColumns(
            {c: actual.select(c).scalar() for c in columns}
        ),
        "model",
    )


def stress_test(gold: DataFrame, suite: Suite, threshold: float = 0.5, seed: int = 42,
                rows: int = 300) -> tuple[DataFrame, DataFrame]:
    """Scenario results and generalization of the suite's best model."""
    best = m.select_candidate(
        suite.metrics.filter("split = 'test'"), by=("business_net_value", "f1")
    ).first()["model"]
    return stress_model(gold, suite.models[best], threshold, seed, rows)


def stress_model(gold: DataFrame, fitted: Fitted, threshold: float = 0.5, seed: int = 42,
                 rows: int = 300) -> tuple[DataFrame, DataFrame]:
    """Scenario results and generalization of one model."""
    columns = list(dict.fromkeys([*ORDER, "leak_label", *sc.MEASURES, *fitted.features]))
    base = sc.stress_baseline(gold.select(*columns), fitted.features, order_columns(), rows, seed)
    clean = sc.scenario_features(checkpointed(sc.scenario_frames(base, seed)), fitted.features)
    # Scores are scaled within each scenario, as one request batch each.
    scored = fitted.score(clean, ("scenario",))
    results = checkpointed(sc.evaluate_scenarios(scored, threshold)).withColumn(
        "model", F.lit(fitted.name)
    )
    return results, sc.generalization(results)


def select_candidate(suite: Suite, gold: DataFrame, mean_f1: DataFrame | None = None) -> DataFrame:
    """The chosen model with its test metrics, gate result and lineage, as one row."""
    best = m.select_candidate(suite.metrics.filter("split = 'test'"))
    passed = g.verdict(suite.gate).select(F.col("subject").alias("model"), "passed")
    return lineage(
        best.join(passed, "model").withColumnRenamed("passed", "register_ready"),
        gold,
        {"threshold_default": 0.5, "cost_missed_leak": m.COST_MISSED_LEAK,
         "cost_false_alarm": m.COST_FALSE_ALARM, "value_early_detection": m.VALUE_EARLY_DETECTION},
        mean_f1,
    )


def lineage(candidate: DataFrame, gold: DataFrame, parameters: dict[str, float],
            generalization: DataFrame | None = None) -> DataFrame:
    """Data version, feature version and parameters beside the candidate's metrics."""
    data = m.fingerprint(gold, sorted(gold.columns)).select(
        F.format_string("%d-%d-%d", "rows", "hash_sum", "hash_xor").alias("version")
    )
    texts = [f"{k}={FEATURE_DICTIONARY.get(k)}" for k in sorted(gold.columns)]
    facts = {
        "data_version": data.scalar(),
        "feature_version": F.sha2(F.lit("\n".join(texts)), 256),
        "parameters": F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()])),
    }
    if generalization is not None:
        facts["generalization_mean_f1"] = generalization.select("mean_f1").scalar()
    return candidate.withColumns(facts)


def run_ledger(metrics: DataFrame, run_id: str, parameters: dict[str, float]) -> DataFrame:
    """(run_id, model, kind, key, value) rows of a run: its parameters and its metrics."""
    long = g.long_metrics(metrics, "model").select(
        F.col("subject").alias("model"), F.lit("metric").alias("kind"),
        F.col("metric").alias("key"), "value",
    )
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("value")) for k, v in parameters.items()]
    )
    params = (
        metrics.select("model").distinct().select("model", F.explode(entries).alias("p"))
        .select("model", F.lit("parameter").alias("kind"), "p.key", "p.value")
    )
    return long.unionByName(params).select(F.lit(run_id).alias("run_id"), "*")


def append_ledger(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def logistic_baseline(gold: DataFrame, train_frac: float = 0.6, val_frac: float = 0.2,
                      iterations: int = 2000) -> DataFrame:
    """Prior and balanced logistic regression over a plain temporal split: scored held-out rows."""
    features = mm.candidate_features(gold)
    keep = list(dict.fromkeys([*ORDER, LABEL, *features]))
    split = sp.plain_temporal_split(checkpointed(gold.select(*keep)), order_columns(), train_frac, val_frac)
    train, held = split.filter("split = 'train'"), split.filter("split <> 'train'")
    if not mm.is_trainable(train, LABEL):
        raise ValueError(mm.SINGLE_CLASS)
    scaler = mm.fit_scaler(train, features)
    model = mm.fit_logistic(mm.apply_scaler(train, scaler), features, LABEL, iterations)
    scored = mm.score_with(model, mm.apply_scaler(held, scaler), features)
    prior = train.agg(F.avg(LABEL).alias("p")).scalar()
    columns = [*ORDER, "split", F.col(LABEL).alias("y"), "score"]
    return (
        scored.select(F.lit("logistic").alias("model"), *columns)
        .unionByName(held.withColumn("score", prior).select(F.lit("prior").alias("model"), *columns))
    )


def train_simple(gold: DataFrame, n_trees: int = 300, seed: int = 42) -> DataFrame:
    """Random forest on the fixed features and a stratified random split: scored test rows."""
    frame = gold.select(*ORDER, *inf.MODEL_FEATURES, F.col("leak_label").cast("int").alias("y"))
    split = sp.stratified_split(checkpointed(frame.fillna(0)), "y", ORDER, seed)
    features = list(inf.MODEL_FEATURES)
    model = mm.fit_random_forest(split.filter("split = 'train'"), features, "y", n_trees, seed=seed)
    scored = mm.score_with(model, split.filter("split = 'test'"), features)
    return scored.select(*ORDER, "y", "score")


def score_batches(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """Predictions for accepted batches of (batch_id, row_index, payload).

    A batch with any bad row is answered with its errors and no scores. Anomaly scores
    are scaled within their batch, so a row's answer does not depend on other batches.
    """
    checked = inf.validate_rows(rows, tuple(fitted.features))
    good = inf.accepted_rows(checked)
    named = good.select(
        "batch_id", "row_index",
        *[F.col("values")[i].alias(f) for i, f in enumerate(fitted.features)],
    )
    return mm.predictions(fitted.score(named, ("batch_id",)), fitted.name, fitted.features)
