"""Trained models and suites as tables, so that training, stress test, choice and scoring are jobs of their own.

A model is a folder: its card, and its trees (isolation forest: one row per node; random forest and boosted trees: one row
per tree, and its cuts; other classifiers: MLlib's own tables). A suite is a folder of tables with its models below it. The card is written
last, so a folder that has one is whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewatch.operators.boosting import BoostedTrees
from pipewatch.operators.forest import RandomForest
from pipewatch.operators.isolation import IsolationForest
from pipewatch.plans import training as tr

CLASSIFIERS = {c.__name__: c for c in (GBTClassificationModel, LogisticRegressionModel)}
FOREST = IsolationForest.__name__
#: Kinds of binned trees, each with what its leaves are called.
BINNED = {RandomForest.__name__: (RandomForest, "scores"), BoostedTrees.__name__: (BoostedTrees, "steps")}
CARD = "name string, kind string, features array<string>, reason string, sample long"
SUITE_CARD = "run_id string, policy string, models array<string>"
#: The parts of a tree that are indexed by node.
NODE = {"feature": "int", "cut": "double", "left": "int", "right": "int", "path": "double"}
TABLES = (
    "split", "scored", "metrics", "sweeps", "best_thresholds", "calibration", "reports", "skipped",
    "sufficiency", "profile", "complexity", "gate",
)


def save_forest(spark: SparkSession, forest: IsolationForest, path: str) -> None:
    """One row per node: at most ``trees * 2 * sample``, whatever the forest was grown on."""
    schema = "tree long, node long, " + ", ".join(f"{k} {t}" for k, t in NODE.items())
    rows = [
        (i, node, *[t[k][node].item() for k in NODE])
        for i, t in enumerate(forest.trees)
        for node in range(len(t["feature"]))
    ]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str, sample: int, features: list[str]) -> IsolationForest:
    nodes = spark.read.parquet(path).orderBy("tree", "node").toPandas()
    kinds = {"int": np.int64, "double": np.float64}
    trees = [
        {k: t[k].to_numpy(dtype=kinds[NODE[k]]) for k in NODE} for _, t in nodes.groupby("tree", sort=True)
    ]
    return IsolationForest(trees, sample, features)


def save_binned(spark: SparkSession, model: RandomForest | BoostedTrees, path: str) -> None:
    """One row per tree and one per feature, whatever the trees were grown on."""
    leaves = BINNED[type(model).__name__][1]
    trees = [(i, splits.tolist(), values.tolist()) for i, (splits, values) in enumerate(zip(model.splits, getattr(model, leaves)))]
    cuts = [(i, c.tolist()) for i, c in enumerate(model.cuts)]
    spark.createDataFrame(trees, f"tree long, splits array<int>, {leaves} array<double>").write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame(cuts, "feature long, cuts array<double>").write.mode("overwrite").parquet(f"{path}/cuts")


def load_binned(spark: SparkSession, kind: str, path: str, features: list[str]) -> RandomForest | BoostedTrees:
    model, leaves = BINNED[kind]
    trees = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
    cuts = spark.read.parquet(f"{path}/cuts").orderBy("feature").collect()
    return model(
        np.array([t["splits"] for t in trees], dtype=np.int32), np.array([t[leaves] for t in trees]),
        [np.array(c["cuts"], dtype=float) for c in cuts], features,
    )


def save_model(fitted: tr.Fitted, path: str) -> None:
    """A model as a folder; a skipped one is its card only."""
    spark, model = SparkSession.active(), fitted.model
    if isinstance(model, IsolationForest):
        save_forest(spark, model, f"{path}/trees")
        lines = [(f, float(mean), float(scale)) for f, (mean, scale) in fitted.scaler.items()]
        spark.createDataFrame(lines, "feature string, mean double, scale double").write.mode("overwrite").parquet(f"{path}/scaler")
    elif isinstance(model, RandomForest | BoostedTrees):
        save_binned(spark, model, path)
    elif model is not None:
        model.write().overwrite().save(f"{path}/classifier")
    kind = type(model).__name__ if model is not None else None
    card = (fitted.name, kind, fitted.features, fitted.reason, getattr(model, "sample", None) if kind == FOREST else None)
    spark.createDataFrame([card], CARD).write.mode("overwrite").parquet(f"{path}/card")


def load_model(spark: SparkSession, path: str) -> tr.Fitted:
    card = spark.read.parquet(f"{path}/card").first()
    features = list(card["features"])
    if card["kind"] is None:
        return tr.Fitted(card["name"], features, None, card["reason"])
    if card["kind"] == FOREST:
        forest = load_forest(spark, f"{path}/trees", card["sample"], features)
        lines = spark.read.parquet(f"{path}/scaler").collect()
        return tr.anomaly_model(forest, {r["feature"]: (r["mean"], r["scale"]) for r in lines})
    if card["kind"] in BINNED:
        return tr.probability_model(card["name"], features, load_binned(spark, card["kind"], path, features))
    return tr.probability_model(card["name"], features, CLASSIFIERS[card["kind"]].load(f"{path}/classifier"))


def save_suite(suite: tr.Suite, path: str) -> None:
    spark = suite.split.sparkSession
    for name in TABLES:
        getattr(suite, name).write.mode("overwrite").parquet(f"{path}/{name}")
    for name, fitted in suite.models.items():
        save_model(fitted, f"{path}/models/{name}")
    card = (suite.run_id, suite.policy, list(suite.models))
    spark.createDataFrame([card], SUITE_CARD).write.mode("overwrite").parquet(f"{path}/card")


def load_suite(spark: SparkSession, path: str) -> tr.Suite:
    card = spark.read.parquet(f"{path}/card").first()
    tables: dict[str, DataFrame] = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    models = {name: load_model(spark, f"{path}/models/{name}") for name in card["models"]}
    return tr.Suite(run_id=card["run_id"], policy=card["policy"], models=models, **tables)


# --- jobs over paths -----------------------------------------------------------------


def train_job(spark: SparkSession, gold: str, suite: str, **settings) -> None:
    """Gold table in, suite folder out."""
    save_suite(tr.train_suite(spark.read.parquet(gold), **settings), suite)


def stress_job(spark: SparkSession, gold: str, suite: str, out: str, **settings) -> None:
    """Scenario results and generalization of the suite's best model."""
    results, overall = tr.stress_test(spark.read.parquet(gold), load_suite(spark, suite), **settings)
    results.write.mode("overwrite").parquet(f"{out}/results")
    overall.write.mode("overwrite").parquet(f"{out}/generalization")


def select_job(spark: SparkSession, gold: str, suite: str, out: str, stress: str | None = None) -> None:
    """The candidate row, with the stress test's mean F1 if one was run, and a copy of its model."""
    stored = load_suite(spark, suite)
    overall = spark.read.parquet(f"{stress}/generalization") if stress else None
    tr.select_candidate(stored, spark.read.parquet(gold), overall).write.mode("overwrite").parquet(f"{out}/candidate")
    chosen = spark.read.parquet(f"{out}/candidate").first()["model"]
    save_model(stored.models[chosen], f"{out}/model")


def score_job(spark: SparkSession, rows: str, model: str, out: str) -> None:
    """Predictions for stored request rows (batch_id, row_index, payload)."""
    answered = tr.score_batches(spark.read.parquet(rows), load_model(spark, model))
    answered.withColumn("scored_at", F.current_timestamp()).write.mode("overwrite").parquet(out)
