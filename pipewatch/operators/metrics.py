"""Evaluation of scored rows: columns ``y`` (0/1) and ``score``.

Global-order metrics go through counted scores or ranked blocks, so no metric
sorts all rows in one task, and thresholds never multiply the scored rows: a
row carries the number of thresholds it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.functions.expr import ratio, scalars
from pipewatch.operators.ordered import next_event_ranks, running_sums, values_at_ranks, with_rank

# Business inputs and the threshold grid in twentieths.
COST_MISSED_LEAK = 5000.0
COST_FALSE_ALARM = 500.0
VALUE_EARLY_DETECTION = 2500.0
THRESHOLDS = [k / 20 for k in range(2, 19)]


def confusion(df: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    predicted, actual = F.col("score") >= threshold, F.col("y") == 1
    return df.groupBy(*by).agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )


def precision_recall_f1(tp="tp", fp="fp", fn="fn") -> dict[str, Column]:
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def business_value(
    missed: float = COST_MISSED_LEAK,
    alarm: float = COST_FALSE_ALARM,
    early: float = VALUE_EARLY_DETECTION,
) -> dict[str, Column]:
    lost, spent = F.col("fn") * F.lit(missed), F.col("fp") * F.lit(alarm)
    gained = F.col("tp") * F.lit(early)
    return {
        "business_cost_missed_leaks": lost,
        "business_cost_false_alarms": spent,
        "business_value_early_detection": gained,
        "business_net_value": gained - lost - spent,
    }


def classification_report(conf: DataFrame) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support, with the accuracy."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    classes = conf.withColumns(
        {
            **{f"leak_{k}": v for k, v in precision_recall_f1().items()},
            **{f"no_{k}": v for k, v in precision_recall_f1("tn", "fn", "fp").items()},
            "leak_support": F.col("tp") + F.col("fn"),
            "no_support": F.col("tn") + F.col("fp"),
            "n": n,
            "accuracy": ratio(F.col("tn") + F.col("tp"), n),
        }
    )
    scores = ("precision", "recall", "f1")

    def weighted(s: str) -> Column:
        total = F.col(f"leak_{s}") * F.col("leak_support") + F.col(f"no_{s}") * F.col("no_support")
        return ratio(total, F.col("n")).alias(s)

    def row(label: str, columns: list[Column], support: str) -> Column:
        return F.struct(F.lit(label).alias("label"), *columns, F.col(support).alias("support"))

    lines = F.array(
        row("no_leak", [F.col(f"no_{s}").alias(s) for s in scores], "no_support"),
        row("leak", [F.col(f"leak_{s}").alias(s) for s in scores], "leak_support"),
        row("macro avg", [((F.col(f"leak_{s}") + F.col(f"no_{s}")) / 2).alias(s) for s in scores], "n"),
        row("weighted avg", [weighted(s) for s in scores], "n"),
    )
    keep = [c for c in conf.columns if c not in ("tn", "fp", "fn", "tp")]
    return classes.select(*keep, F.explode(lines).alias("line"), "accuracy").select(
        *keep, "line.*", "accuracy"
    )


def average_precision(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under precision-recall by steps of distinct scores; 0 without positives."""
    groups = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    counted = rows.groupBy(*groups, "score").agg(
        F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    order = [*[F.col(g) for g in groups], F.col("score").desc()]
    steps = running_sums(counted, order, {"cum_pos": "pos", "cum_n": "n"})
    base = steps.groupBy(*groups).agg(
        F.min(F.col("cum_pos") - F.col("pos")).alias("pos0"),
        F.min(F.col("cum_n") - F.col("n")).alias("n0"),
        F.sum("pos").alias("positives"),
    )
    precision = (F.col("cum_pos") - F.col("pos0")) / (F.col("cum_n") - F.col("n0"))
    step = ratio(F.col("pos"), F.col("positives")) * precision
    out = steps.join(base if by else F.broadcast(base), groups).groupBy(*groups).agg(F.sum(step).alias("pr_auc"))
    return out if by else out.drop("_all")


def clipped(score: str = "score") -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))


def brier_score(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.pow(clipped() - F.col("y"), 2)).alias("brier_score"))


def calibration_curve(df: DataFrame, bins: int = 8) -> DataFrame:
    """Mean outcome and mean score per quantile bin; a score on an edge goes left."""
    rows = df.select("y", clipped().alias("s"))
    ranks = {}
    for j in range(1, bins):
        ranks[f"lo{j}"] = lambda n, j=j: F.floor(F.lit(j / bins) * (n - 1))
        ranks[f"hi{j}"] = lambda n, j=j: F.ceil(F.lit(j / bins) * (n - 1))
    found = values_at_ranks(rows, "s", ranks)

    def edge(j: int) -> Column:
        place = F.lit(j / bins) * (F.col("n") - 1)
        low, high = F.col(f"lo{j}"), F.col(f"hi{j}")
        return low + (high - low) * (place - F.floor(place))

    edges = found.select(F.array(*[edge(j) for j in range(1, bins)]).alias("edges"))
    binned = rows.withColumn("edges", edges.scalar()).withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("s")))
    )
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("y").alias("prob_true"), F.avg("s").alias("prob_pred")
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    """Plain mean over the non-empty bins of the gap between outcome and score."""
    gap = F.abs(F.col("prob_true") - F.col("prob_pred"))
    return curve.agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("expected_calibration_error"))


def detection_delays(ranked: DataFrame, n_rows: Column, reached: dict[str, Column]) -> DataFrame:
    """Mean steps from a positive row to the next predicted positive, one column per prediction.

    A positive row that no prediction follows counts the rows left.
    """
    nexts = next_event_ranks(ranked, "rank", reached).withColumn("_n", n_rows)
    positives = nexts.filter(F.col("y") == 1)
    return positives.agg(
        *[F.avg(F.coalesce(name, "_n") - F.col("rank")).alias(name) for name in reached]
    )


def false_alarm_frequency(fp: Column, first: Column, last: Column) -> Column:
    """False alarms per day of the covered time, a day at least."""
    days = (F.unix_micros(last) - F.unix_micros(first)) / F.lit(86400e6)
    per_day = fp.cast("double") / F.greatest(days, F.lit(1.0))
    return F.when(fp == 0, F.lit(0.0)).when(first.isNull(), fp.cast("double")).otherwise(per_day)


def sweep(
    df: DataFrame,
    order: list[str],
    time: str = "ts",
    thresholds: list[float] = THRESHOLDS,
    missed: float = COST_MISSED_LEAK,
    alarm: float = COST_FALSE_ALARM,
    early: float = VALUE_EARLY_DETECTION,
) -> DataFrame:
    """Every threshold metric, one row per threshold."""
    grid = sorted(thresholds)
    level = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    slim = df.select(*dict.fromkeys([*order, "y", "score", time]))
    ranked = with_rank(slim, [F.col(c) for c in order]).withColumn("level", level)
    instant = F.col(time).cast("timestamp")
    overall = scalars(
        ranked.agg(F.count(F.lit(1)).alias("n"), F.min(instant).alias("first"), F.max(instant).alias("last"))
    )

    steps = F.explode(F.sequence(F.lit(1), F.lit(len(grid))))
    hist = ranked.groupBy("level", "y").agg(F.count(F.lit(1)).alias("n"))
    reach, actual = F.col("level") >= F.col("k"), F.col("y") == 1

    def cell(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counts = hist.withColumn("k", steps).groupBy("k").agg(
        cell(~actual & ~reach).alias("tn"),
        cell(~actual & reach).alias("fp"),
        cell(actual & ~reach).alias("fn"),
        cell(actual & reach).alias("tp"),
    )
    names = {f"delay_{k}": F.col("level") >= k for k in range(1, len(grid) + 1)}
    one = detection_delays(ranked.select("rank", "y", "level"), overall["n"], names)
    delays = one.select(F.posexplode(F.array(*names)).alias("k", "delay")).withColumn("k", F.col("k") + 1)
    threshold = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("k"))
    return (
        counts.join(delays, "k", "left")
        .withColumns(
            {
                "first": overall["first"],
                "last": overall["last"],
                "pr_auc": average_precision(slim).scalar(),
            }
        )
        .select(
            threshold.alias("threshold"),
            *[c.alias(n) for n, c in precision_recall_f1().items()],
            "pr_auc",
            "tn",
            "fp",
            "fn",
            "tp",
            F.coalesce("delay", F.lit(0.0)).alias("detection_delay_steps"),
            false_alarm_frequency(F.col("fp"), F.col("first"), F.col("last")).alias(
                "false_alarm_frequency_per_day"
            ),
            *[c.alias(n) for n, c in business_value(missed, alarm, early).items()],
        )
    )


def evaluate(df: DataFrame, order: list[str], threshold: float = 0.5, **options) -> DataFrame:
    """All metrics at one threshold."""
    return sweep(df, order, thresholds=[threshold], **options)


def best_threshold(swept: DataFrame) -> DataFrame:
    """Highest net value, then highest F1, then the lowest threshold."""
    return swept.orderBy(
        F.col("business_net_value").desc(), F.col("f1").desc(), F.col("threshold").asc()
    ).limit(1)


def model_metrics(df: DataFrame, by: str = "model", threshold: float = 0.5) -> DataFrame:
    """Confusion, precision, recall, F1, PR-AUC and value per model."""
    conf = confusion(df, threshold, (by,)).withColumns({**precision_recall_f1(), **business_value()})
    return conf.join(average_precision(df, (by,)), by)


def select_candidate(models: DataFrame, name: str = "model",
                     by: tuple[str, ...] = ("business_net_value", "pr_auc", "f1")) -> DataFrame:
    """The model that is best on the keys, in their order; ties go to the first name."""
    return models.orderBy(*[F.col(c).desc() for c in by], F.col(name).asc()).limit(1)


def score_deltas(blue: DataFrame, green: DataFrame, key: str) -> DataFrame:
    """Both score sets side by side; a row on one side only is a mismatch."""
    pairs = blue.select(key, F.col("score").alias("blue")).join(
        green.select(key, F.col("score").alias("green")), key, "full_outer"
    )
    return pairs.withColumns(
        {
            "delta": F.abs(F.col("blue") - F.col("green")),
            "matched": F.col("blue").isNotNull() & F.col("green").isNotNull(),
        }
    )


def delta_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count_if("matched").alias("n_rows"),
        F.count_if(~F.col("matched")).alias("mismatched_rows"),
        F.coalesce(F.max("delta"), F.lit(0.0)).alias("max_score_delta"),
        F.coalesce(F.avg("delta"), F.lit(0.0)).alias("mean_score_delta"),
    )


# Fixed values: (model, reason when justified, reason when not) of the complexity rules.
COMPLEX_MODELS = [
    (
        "autoencoder",
        "High-dimensional, large-sample anomaly learning possible",
        "Not enough rows/features for stable autoencoder training",
    ),
    (
        "lstm",
        "Sufficient temporal volume for sequence modeling",
        "Temporal sample volume too small for robust LSTM",
    ),
    (
        "gnn",
        "Topology-aware learning likely beneficial",
        "Topology coverage/scale does not justify GNN complexity",
    ),
]


def complexity_rules(df: DataFrame, feature_count: int, sensor: str = "sensor_node_id",
                     time: str = "event_ts_utc", degree: str = "node_degree") -> DataFrame:
    """Which larger models the data would justify."""
    sensors = F.count_distinct(sensor) if sensor in df.columns else F.lit(0)
    facts = df.agg(F.count(F.lit(1)).alias("rows"), sensors.cast("long").alias("sensors"))
    rules = {
        "autoencoder": (F.col("rows") >= 5000) & F.lit(feature_count >= 20),
        "lstm": (F.col("rows") >= 8000) & F.lit(time in df.columns),
        "gnn": F.lit(degree in df.columns) & (F.col("sensors") >= 25) & (F.col("rows") >= 5000),
    }
    lines = F.array(
        *[
            F.struct(
                F.lit(model).alias("model"),
                rules[model].alias("justified"),
                F.when(rules[model], yes).otherwise(no).alias("reason"),
            )
            for model, yes, no in COMPLEX_MODELS
        ]
    )
    return facts.select("rows", "sensors", F.explode(lines).alias("r")).select(
        "r.*", "rows", "sensors", F.lit(False).alias("trained")
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """A version of the rows that does not depend on their order or partitioning."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    short = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.select(short.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h").alias("hash_sum"), F.bit_xor("h").alias("hash_xor")
    )
