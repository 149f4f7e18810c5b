"""Stress scenarios and synthetic augmentation, with draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.functions.expr import normal, ratio, uniform
from pipewatch.operators.inference import finite
from pipewatch.operators.ordered import with_rank

# Fixed values: (scenario, share of rows hit, pressure factor, flow factor, demand factor, sets label).
MASKED = [
    ("small_leak", 0.12, 0.97, 1.05, 1.0, True),
    ("large_leak", 0.12, 0.82, 1.35, 1.0, True),
    ("different_leak_locations", 0.10, 1.0, 1.0, 1.0, True),
    ("demand_spike", 0.20, 1.0, 1.0, 1.8, False),
    ("leakg3pd_scenario_a", 0.08, 0.9, 1.15, 1.0, True),
    ("leakg3pd_scenario_b", 0.15, 0.86, 1.25, 1.0, True),
]
SCENARIOS = [s[0] for s in MASKED] + [
    "pressure_variation",
    "sensor_noise",
    "missing_sensors",
    "malformed_inputs",
    "extreme_values",
    "partial_telemetry",
]
GENERALIZATION = [
    "small_leak",
    "large_leak",
    "different_leak_locations",
    "leakg3pd_scenario_a",
    "leakg3pd_scenario_b",
]
RELOCATED = ("N1", "N2", "N3", "N4")
MEASURES = ("pressure", "flow", "demand")
#: Draws from which on ranked rows are looked up in hash tables, so that draws need no sort.
MANY = 1_000_000


def resample(df: DataFrame, order: list[Column], n_rows: int, seed: int) -> DataFrame:
    """Rows drawn with replacement: draw i takes the row at place floor(u_i * n).

    The draws are joined to the ranked rows on that place; both sides spread
    evenly, whatever the data looks like. Many draws are not sorted for it.
    """
    ranked = with_rank(df, order, "_place")
    if n_rows >= MANY:
        ranked = ranked.hint("shuffle_hash")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    draws = df.sparkSession.range(n_rows).select(
        F.col("id").alias("sample_id"),
        F.floor(uniform(seed, "id") * n.scalar()).alias("_place"),
    )
    return draws.join(ranked, "_place").drop("_place")


def stress_baseline(gold: DataFrame, features: list[str], order: list[Column], rows: int = 300,
                    seed: int = 42, jitter: float = 0.03) -> DataFrame:
    """At least 50 resampled rows with a little noise on every feature."""
    sample = resample(gold, order, max(rows, 50), seed)
    noisy = {
        f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        + F.lit(jitter) * normal(f"{seed}:{f}", "sample_id")
        for f in features
    }
    return sample.withColumns(noisy)


def scenario_frames(base: DataFrame, seed: int = 42, row_id: str = "sample_id") -> DataFrame:
    """Every scenario's version of every row, in one pass.

    Only the raw measures change; lags and rolling means stay as they were.
    """
    n = base.agg(
        F.count(F.lit(1)).alias("n"), *[F.stddev_samp(m).alias(f"std_{m}") for m in MEASURES]
    )
    # The 5 % hit by extreme values are the rows with the smallest draws.
    extreme = with_rank(
        base.withColumn("_u", uniform(f"{seed}:extreme_values", row_id)), [F.col("_u"), F.col(row_id)], "_extreme"
    ).drop("_u")
    names = F.explode(F.array(*[F.lit(s) for s in SCENARIOS]))
    rows = extreme.withColumns(
        {
            "scenario": names,
            "_n": n.select("n").scalar(),
            **{f"_std_{m}": n.select(f"std_{m}").scalar() for m in MEASURES},
        }
    )
    scenario = F.col("scenario")
    draw = uniform(f"{seed}:mask", "scenario", row_id)
    factors = {m: F.lit(1.0) for m in MEASURES}
    label = F.col("leak_label")
    for name, share, p, f, d, sets_label in MASKED:
        hit = (scenario == name) & (draw < share)
        for m, factor in zip(MEASURES, (p, f, d)):
            if factor != 1.0:
                factors[m] = F.when(hit, F.lit(factor)).otherwise(factors[m])
        if sets_label:
            label = F.when(hit, 1).otherwise(label)
    is_extreme = (scenario == "extreme_values") & (
        F.col("_extreme") < F.greatest(F.lit(1), F.floor(F.lit(0.05) * F.col("_n")))
    )
    factors["pressure"] = F.when(is_extreme, 4.5).otherwise(factors["pressure"])
    factors["flow"] = F.when(is_extreme, 4.0).otherwise(factors["flow"])
    factors["pressure"] = F.when(
        scenario == "pressure_variation",
        F.lit(1.0) + F.lit(0.12) * normal(f"{seed}:pressure_variation", row_id),
    ).otherwise(factors["pressure"])
    changed = {}
    for m in MEASURES:
        noise = F.lit(0.18) * F.greatest(F.lit(1e-6), F.col(f"_std_{m}")) * normal(
            f"{seed}:sensor_noise:{m}", row_id
        )
        lost = (scenario == "missing_sensors") & (uniform(f"{seed}:missing:{m}", row_id) < 0.25)
        value = F.col(m) * factors[m] + F.when(scenario == "sensor_noise", noise).otherwise(0.0)
        changed[m] = F.when(~lost, value)
    place = F.floor(uniform(f"{seed}:location", row_id) * len(RELOCATED)).cast("int")
    moved = F.element_at(F.array(*[F.lit(r) for r in RELOCATED]), place + 1)
    changed["sensor_node_id"] = F.when(scenario == "different_leak_locations", moved).otherwise(
        F.col("sensor_node_id")
    )
    changed["leak_label"] = label
    kept = (scenario != "partial_telemetry") | (uniform(f"{seed}:partial", row_id) > 0.3)
    return (
        rows.filter(kept)
        .withColumns(changed)
        .drop("_extreme", "_n", *[f"_std_{m}" for m in MEASURES])
    )


def evaluate_scenarios(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per scenario: rows, mean score, precision, recall, F1, positive rate.

    Malformed inputs are only counted; their row says they were handled.
    """
    predicted, actual = F.col("score") >= threshold, F.col("leak_label") == 1
    tp, fp, fn = (
        F.count_if(actual & predicted),
        F.count_if(~actual & predicted),
        F.count_if(actual & ~predicted),
    )
    raw = scored.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("score").alias("mean_score"),
        ratio(tp, F.greatest(tp + fp, F.lit(1))).alias("precision"),
        ratio(tp, F.greatest(tp + fn, F.lit(1))).alias("recall"),
        F.avg(predicted.cast("int")).alias("predicted_positive_rate"),
    )
    p, r = F.col("precision"), F.col("recall")
    raw = raw.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))
    handled = F.col("scenario") == "malformed_inputs"
    numbers = ["mean_score", "precision", "recall", "f1", "predicted_positive_rate"]
    return raw.withColumn("status", F.when(handled, "handled").otherwise("ok")).withColumns(
        {c: F.when(~handled, F.col(c)) for c in numbers}
    )


def generalization(results: DataFrame) -> DataFrame:
    """Mean and least F1 over the leak scenarios."""
    return results.filter(F.col("scenario").isin(*GENERALIZATION)).agg(
        F.count("f1").alias("scenarios"), F.avg("f1").alias("mean_f1"), F.min("f1").alias("min_f1")
    )


def scenario_features(frames: DataFrame, features: list[str]) -> DataFrame:
    """Scenario rows with clean numbers, ready for scoring."""
    return frames.withColumns({f: finite(F.col(f).cast("double")) for f in features})


def augment(seeds: DataFrame, order: list[Column], multiplier: int = 40, leak_boost: float = 1.2,
            seed: int = 42) -> DataFrame:
    """Synthetic readings: resampled, shifted by up to 5 minutes, noisy, relabelled.

    ``seeds`` has a time column ``timestamp``, the measures and the label.
    """
    n = seeds.count()
    rate = seeds.agg(F.avg("leak_label").alias("rate")).scalar()
    rows = resample(seeds, order, max(n * multiplier, n), seed)
    i = "sample_id"
    shift = F.floor(uniform(f"{seed}:minutes", i) * 11) - 5
    label = F.when(
        uniform(f"{seed}:label", i) < F.least(rate * leak_boost, F.lit(0.35)), 1
    ).otherwise(0)
    rows = rows.withColumns({"_moved": shift * 60, "leak_label": label})
    leak = F.col("leak_label") == 1

    def floored(measure: str, value: Column) -> Column:
        """At least 0; a missing measure stays missing."""
        return F.when(F.col(measure).isNotNull(), F.greatest(value, F.lit(0.0)))

    def noisy(m: str, scale: float) -> Column:
        return floored(m, F.col(m) * (1.0 + F.lit(scale) * normal(f"{seed}:{m}", i)))

    def under_leak(name: str, low: float, high: float) -> Column:
        factor = F.lit(low) + F.lit(high - low) * uniform(f"{seed}:leak:{name}", i)
        return F.when(leak, floored(name, F.col(name) * factor)).otherwise(F.col(name))

    # The noise is a step of its own: an expression named twice would draw twice.
    rows = rows.withColumns({"pressure": noisy("pressure", 0.04), "flow": noisy("flow", 0.06), "demand": noisy("demand", 0.06)})
    return rows.withColumns(
        {
            "timestamp": F.timestamp_seconds(
                F.unix_timestamp(F.col("timestamp").cast("timestamp")) + F.col("_moved")
            ),
            "pressure": under_leak("pressure", 0.75, 0.95),
            "flow": under_leak("flow", 1.05, 1.35),
        }
    ).drop("_moved")


def augmentation_summary(seeds: DataFrame, synthetic: DataFrame) -> DataFrame:
    before = seeds.agg(F.count(F.lit(1)).alias("n"), F.avg("leak_label").alias("r"))
    after = synthetic.agg(
        F.count(F.lit(1)).alias("synthetic_rows"), F.avg("leak_label").alias("synthetic_leak_rate")
    )
    return after.withColumns(
        {"seed_rows": before.select("n").scalar(), "seed_leak_rate": before.select("r").scalar()}
    )
