"""Model features, training and scoring."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewatch.operators.boosting import BoostedTrees, GBTClassifier, boosted_scores
from pipewatch.operators.forest import RandomForest, fit_forest, forest_scores

# Columns that identify rows, and the target columns.
NOT_FEATURES = {
    "sensor_node_id", "_ingest_ts", "_source_file", "_source_type", "_row_hash", "pressure_unit",
    "flow_unit", "demand_unit", "pressure_unit_standard", "flow_unit_standard",
    "demand_unit_standard", "event_ts_utc", "target_leak_horizon", "leak_label",
}
NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double")


def candidate_features(df: DataFrame) -> list[str]:
    """Numeric columns that are neither identifiers nor targets, sorted by name."""
    return sorted(n for n, t in df.dtypes if t in NUMERIC and n not in NOT_FEATURES)


def leaking_features(names: list[str]) -> list[str]:
    """Names that give the future away."""
    return [n for n in names if "target" in n.lower() or "future" in n.lower()]


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    whole = sizes.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))
    n, k = whole.select("n").scalar(), whole.select("k").scalar()
    return sizes.withColumn("weight", n / (k * F.col("rows")))


def scaler_stats(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, scale) with the population deviation, 1 where it is 0."""
    clean = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    one = train.select(*[c.alias(f) for f, c in clean.items()]).agg(
        *[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f)["mean"].alias("mean"),
                F.when(F.col(f)["std"] > 0, F.col(f)["std"]).otherwise(1.0).alias("scale"),
            )
            for f in features
        ]
    )
    return one.select(F.explode(lines).alias("l")).select("l.*")


def fit_scaler(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Two numbers per feature."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler_stats(train, features).collect()}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {
            f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(mean)) / F.lit(scale)
            for f, (mean, scale) in scaler.items()
        }
    )


# Fixed value: the reason given for a skipped model.
SINGLE_CLASS = "Train split has a single class; supervised model not trainable"


def is_trainable(train: DataFrame, label: str) -> bool:
    """More than one class among the training rows."""
    one = train.agg(F.min(label).alias("a"), F.max(label).alias("b")).first()
    return one["a"] is not None and one["a"] != one["b"]


def with_weights(train: DataFrame, label: str) -> DataFrame:
    weights = class_weights(train, label).select(label, "weight")
    # One row per class.
    return train.join(F.broadcast(weights), label)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    clean = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    return VectorAssembler(inputCols=features, outputCol="features_vector").transform(
        df.withColumns(clean)
    )


def fit_random_forest(train: DataFrame, features: list[str], label: str, n_trees: int = 400,
                      depth: int = 10, seed: int = 42, balanced: bool = True):
    """Random forest on all class-weighted rows."""
    weights = {}
    if balanced:
        weights = {int(r[label]): r["weight"] for r in class_weights(train, label).collect() if r[label] is not None}
    return fit_forest(train, features, label, weights, n_trees, depth, seed)


def fit_boosted_trees(train: DataFrame, features: list[str], label: str, rounds: int = 300,
                      depth: int = 4, rate: float = 0.05, sample: float = 0.9, seed: int = 42):
    """Gradient-boosted trees over samples of rows and columns."""
    model = GBTClassifier(
        featuresCol=features, labelCol=label, maxIter=rounds, maxDepth=depth,
        stepSize=rate, subsamplingRate=sample, featureSubsetStrategy=str(sample), seed=seed,
    )
    return model.fit(train)


def fit_logistic(train: DataFrame, features: list[str], label: str, iterations: int = 2000):
    """Balanced logistic regression; the caller scales the features."""
    model = LogisticRegression(
        featuresCol="features_vector", labelCol=label, weightCol="weight", maxIter=iterations,
        regParam=0.0, standardization=False,
    )
    return model.fit(assembled(with_weights(train, label), features))


def score_with(model, df: DataFrame, features: list[str]) -> DataFrame:
    """df plus ``score``, the probability of a leak."""
    if isinstance(model, RandomForest | BoostedTrees):
        scores = forest_scores if isinstance(model, RandomForest) else boosted_scores
        return scores(df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}), model)
    scored = model.transform(assembled(df, features))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "features_vector", "rawPrediction", "probability", "prediction"
    )


def predictions(scored: DataFrame, model_name: str, features: list[str]) -> DataFrame:
    """Scores with the leak flag, model name and feature count of a scoring answer."""
    return scored.withColumns(
        {
            "is_leak": (F.col("score") >= 0.5).cast("int"),
            "model_name": F.lit(model_name),
            "feature_count": F.lit(len(features)),
        }
    )
