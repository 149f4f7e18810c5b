"""Evaluation, split and threshold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog.medallion import gold_frame
from pipewatch.catalog.registry import CTES, query
from pipewatch.functions.expr import ratio, rounded
from pipewatch.operators import metrics as m
from pipewatch.operators import splits as sp
from pipewatch.operators.ordered import lower_quantiles, next_event_ranks, running_sums, with_rank
from pipewatch.sources.views import table, view

ORDER = ["ts", "event_id"]

CTES["ranked"] = "SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rank FROM scored"
CTES["rank_size"] = "SELECT count(*) AS n FROM scored"
CTES["all_split"] = """
    SELECT r.*, CASE WHEN rank < greatest(2, floor(n * 0.6)) THEN 'train'
        WHEN rank < least(n - 1, greatest(greatest(2, floor(n * 0.6)) + 1, floor(n * 0.8))) THEN 'val'
        ELSE 'test' END AS split
    FROM ranked r, rank_size"""
CTES["real_split"] = """
    SELECT s.*, CASE WHEN _source_type <> 'real' THEN 'train'
        WHEN rr < greatest(2, floor(n * 0.6)) THEN 'train'
        WHEN rr < least(n - 1, greatest(greatest(2, floor(n * 0.6)) + 1, floor(n * 0.8))) THEN 'val'
        ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY _source_type ORDER BY ts, event_id) - 1 AS rr FROM scored) s,
      (SELECT count(*) AS n FROM scored WHERE _source_type = 'real')"""
CTES["grid"] = "SELECT k / 20.0 AS threshold FROM range(2, 19) t(k)"
_CONF = """count(*) FILTER (WHERE y = 0 AND score < threshold) AS tn,
      count(*) FILTER (WHERE y = 0 AND score >= threshold) AS fp,
      count(*) FILTER (WHERE y = 1 AND score < threshold) AS fn,
      count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp"""
_PRF = """coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""
CTES["grid_confusion"] = f"SELECT threshold, {_CONF} FROM scored, grid GROUP BY threshold"
CTES["half_confusion"] = f"SELECT {_CONF} FROM scored, (SELECT 0.5 AS threshold)"
CTES["pr_steps"] = """
    SELECT score, pos, n, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(n) OVER (ORDER BY score DESC) AS cum_n
    FROM (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score)"""
CTES["pr_auc_value"] = """
    SELECT coalesce(sum(pos / (SELECT sum(y) FROM scored) * (cum_pos / cum_n)), 0) AS pr_auc FROM pr_steps"""
CTES["next_positive"] = """
    SELECT threshold, rank, y, min(CASE WHEN score >= threshold THEN rank END) OVER (PARTITION BY threshold
      ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_rank FROM ranked, grid"""
CTES["grid_delay"] = """
    SELECT threshold, avg(coalesce(next_rank, n) - rank) AS delay FROM next_positive, rank_size
    WHERE y = 1 GROUP BY threshold"""
CTES["grid_metrics"] = f"""
    SELECT c.threshold, {_PRF}, pr_auc, tn, fp, fn, tp, coalesce(delay, 0) AS detection_delay_steps,
      CASE WHEN fp = 0 THEN 0 ELSE fp / greatest(days, 1) END AS false_alarm_frequency_per_day,
      fn * 5000.0 AS business_cost_missed_leaks, fp * 500.0 AS business_cost_false_alarms,
      tp * 2500.0 AS business_value_early_detection,
      tp * 2500.0 - fn * 5000.0 - fp * 500.0 AS business_net_value
    FROM grid_confusion c JOIN grid_delay d ON d.threshold = c.threshold, pr_auc_value,
      (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days FROM scored)"""
CTES["model_confusion"] = f"""
    SELECT model, {_CONF} FROM model_scores, (SELECT 0.5 AS threshold) GROUP BY model"""
CTES["model_pr"] = """
    SELECT model, sum(pos / total * (cum_pos / cum_n)) AS pr_auc FROM (
      SELECT model, pos, sum(pos) OVER (PARTITION BY model) AS total,
        sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS cum_pos,
        sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS cum_n
      FROM (SELECT model, score, sum(y) AS pos, count(*) AS n FROM model_scores GROUP BY 1, 2)) GROUP BY model"""
CTES["model_table"] = f"""
    SELECT c.model, tn, fp, fn, tp, {_PRF}, pr_auc, fn * 5000.0 AS business_cost_missed_leaks,
      fp * 500.0 AS business_cost_false_alarms, tp * 2500.0 AS business_value_early_detection,
      tp * 2500.0 - fn * 5000.0 - fp * 500.0 AS business_net_value
    FROM model_confusion c JOIN model_pr p ON p.model = c.model"""

SWEEP_FLOATS = [
    "threshold", "precision", "recall", "f1", "pr_auc", "detection_delay_steps",
    "false_alarm_frequency_per_day", "business_cost_missed_leaks", "business_cost_false_alarms",
    "business_value_early_detection", "business_net_value",
]
SWEEP_OUT = ", ".join(f'round("{c}", 6) AS "{c}"' for c in SWEEP_FLOATS) + ", tn, fp, fn, tp"


def scored(spark, sf):
    return view(spark, sf, "scored")


@query(
    "d12_confusion",
    "SELECT tn, fp, fn, tp FROM half_confusion",
)
def d12(spark, sf):
    return m.confusion(scored(spark, sf), 0.5)


@query(
    "d13_precision_recall_f1",
    f'SELECT round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 '
    f"FROM (SELECT {_PRF} FROM half_confusion)",
)
def d13(spark, sf):
    conf = m.confusion(scored(spark, sf), 0.5)
    return rounded(conf.select(*[c.alias(n) for n, c in m.precision_recall_f1().items()]))


_REPORT = """
    WITH c AS (SELECT *, tp + fn AS p, tn + fp AS n0, tn + fp + fn + tp AS n,
        tp / (tp + fp) AS lp, tp / (tp + fn) AS lr, 2 * tp / (2 * tp + fp + fn) AS lf,
        tn / (tn + fn) AS np, tn / (tn + fp) AS nr, 2 * tn / (2 * tn + fp + fn) AS nf FROM half_confusion),
    lines AS (
      SELECT 'no_leak' AS label, np AS "precision", nr AS recall, nf AS f1, n0 AS support FROM c
      UNION ALL SELECT 'leak', lp, lr, lf, p FROM c
      UNION ALL SELECT 'macro avg', (lp + np) / 2, (lr + nr) / 2, (lf + nf) / 2, n FROM c
      UNION ALL SELECT 'weighted avg', (lp * p + np * n0) / n, (lr * p + nr * n0) / n, (lf * p + nf * n0) / n, n FROM c)
    SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support,
      round((SELECT (tn + tp) / n FROM c), 6) AS accuracy FROM lines"""


@query("d14_classification_report", _REPORT)
def d14(spark, sf):
    return rounded(m.classification_report(m.confusion(scored(spark, sf), 0.5)))


@query("d15_average_precision", "SELECT round(pr_auc, 6) AS pr_auc FROM pr_auc_value")
def d15(spark, sf):
    return rounded(m.average_precision(scored(spark, sf)))


@query(
    "d16_brier_score",
    "SELECT round(avg(pow(greatest(0, least(1, score)) - y, 2)), 6) AS brier_score FROM scored",
)
def d16(spark, sf):
    return rounded(m.brier_score(scored(spark, sf)))


_CURVE = """
    WITH e AS (SELECT quantile_cont(score, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS edges FROM scored),
    binned AS (SELECT y, score, len(list_filter(edges, lambda x: x < score)) AS bin FROM scored, e),
    curve AS (SELECT bin, count(*) AS n_rows, avg(y) AS prob_true, avg(score) AS prob_pred FROM binned GROUP BY bin)"""


@query(
    "d17_calibration_curve",
    _CURVE
    + """SELECT CAST(bin AS INTEGER) AS bin, n_rows, round(prob_true, 6) AS prob_true,
           round(prob_pred, 6) AS prob_pred FROM curve""",
)
def d17(spark, sf):
    curve = m.calibration_curve(scored(spark, sf)).withColumnRenamed("rows", "n_rows")
    return rounded(curve)


@query(
    "d17_calibration_error",
    _CURVE + "SELECT round(avg(abs(prob_true - prob_pred)), 6) AS expected_calibration_error FROM curve",
)
def d17_error(spark, sf):
    return rounded(m.calibration_error(m.calibration_curve(scored(spark, sf))))


@query(
    "e7_next_predicted_positive",
    """SELECT event_id, rank, min(CASE WHEN score >= 0.9 THEN rank END) OVER (ORDER BY rank
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_rank FROM ranked""",
)
def e7(spark, sf):
    ranked = with_rank(scored(spark, sf), [F.col(c) for c in ORDER])
    found = next_event_ranks(ranked, "rank", {"next_rank": F.col("score") >= 0.9})
    return found.select("event_id", "rank", "next_rank")


@query(
    "d18_detection_delay",
    "SELECT round(delay, 6) AS detection_delay_steps FROM grid_delay WHERE threshold = 0.9",
)
def d18(spark, sf):
    one = m.evaluate(scored(spark, sf), ORDER, threshold=0.9)
    return rounded(one.select("detection_delay_steps"))


@query(
    "d19_false_alarm_frequency",
    """SELECT round(false_alarm_frequency_per_day, 6) AS false_alarm_frequency_per_day FROM grid_metrics
       WHERE threshold = 0.5""",
)
def d19(spark, sf):
    instant = F.col("ts").cast("timestamp")
    facts = scored(spark, sf).agg(
        F.count_if((F.col("y") == 0) & (F.col("score") >= 0.5)).alias("fp"),
        F.min(instant).alias("first"),
        F.max(instant).alias("last"),
    )
    value = m.false_alarm_frequency(F.col("fp"), F.col("first"), F.col("last"))
    return rounded(facts.select(value.alias("false_alarm_frequency_per_day")))


@query(
    "d20_business_value",
    """SELECT fn * 5000.0 AS business_cost_missed_leaks, fp * 500.0 AS business_cost_false_alarms,
         tp * 2500.0 AS business_value_early_detection,
         tp * 2500.0 - fn * 5000.0 - fp * 500.0 AS business_net_value FROM half_confusion""",
)
def d20(spark, sf):
    conf = m.confusion(scored(spark, sf), 0.5)
    return conf.select(*[c.alias(n) for n, c in m.business_value().items()])


@query("d21_threshold_evaluation", f"SELECT {SWEEP_OUT} FROM grid_metrics WHERE threshold = 0.5")
def d21(spark, sf):
    return rounded(m.evaluate(scored(spark, sf), ORDER))


@query("d22_threshold_sweep", f"SELECT {SWEEP_OUT} FROM grid_metrics")
def d22(spark, sf):
    return rounded(m.sweep(scored(spark, sf), ORDER))


@query("c8_threshold_grid", "SELECT round(threshold, 6) AS threshold, tn, fp, fn, tp FROM grid_confusion")
def c8(spark, sf):
    swept = m.sweep(scored(spark, sf), ORDER)
    return rounded(swept.select("threshold", "tn", "fp", "fn", "tp"))


@query(
    "f3_best_threshold",
    f"""SELECT {SWEEP_OUT} FROM grid_metrics
        ORDER BY business_net_value DESC, f1 DESC, threshold ASC LIMIT 1""",
)
def f3(spark, sf):
    return rounded(m.best_threshold(m.sweep(scored(spark, sf), ORDER)))


_MODEL_FLOATS = [
    "precision", "recall", "f1", "pr_auc", "business_cost_missed_leaks", "business_cost_false_alarms",
    "business_value_early_detection", "business_net_value",
]
MODEL_OUT = "model, tn, fp, fn, tp, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _MODEL_FLOATS)


@query("j18_model_comparison", """
    SELECT model, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round("precision", 6) AS "precision",
      round(recall, 6) AS recall, round(f1, 6) AS f1, tp + fn AS support,
      CASE WHEN "precision" >= 0.6 AND recall >= 0.6 AND pr_auc >= 0.6 THEN 'PASS' ELSE 'BLOCKED' END AS status
    FROM model_table""")  # fmt: skip
def j18(spark, sf):
    models = m.model_metrics(view(spark, sf, "model_scores"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    passed = (F.col("precision") >= 0.6) & (F.col("recall") >= 0.6) & (F.col("pr_auc") >= 0.6)
    return rounded(
        models.select(
            "model",
            ratio(F.col("tn") + F.col("tp"), n).alias("accuracy"),
            "precision",
            "recall",
            "f1",
            (F.col("tp") + F.col("fn")).alias("support"),
            F.when(passed, "PASS").otherwise("BLOCKED").alias("status"),
        )
    )


@query("model_metrics", f"SELECT {MODEL_OUT} FROM model_table")
def model_metrics(spark, sf):
    return rounded(m.model_metrics(view(spark, sf, "model_scores")))


@query(
    "f1_candidate_selection",
    f"""SELECT {MODEL_OUT} FROM model_table
        ORDER BY business_net_value DESC, pr_auc DESC, f1 DESC, model LIMIT 1""",
)
def f1(spark, sf):
    return rounded(m.select_candidate(m.model_metrics(view(spark, sf, "model_scores"))))


@query(
    "f2_scenario_model",
    f"SELECT {MODEL_OUT} FROM model_table ORDER BY business_net_value DESC, f1 DESC, model LIMIT 1",
)
def f2(spark, sf):
    models = m.model_metrics(view(spark, sf, "model_scores"))
    return rounded(m.select_candidate(models, by=("business_net_value", "f1")))


# --- splits -------------------------------------------------------------------------


def time_order():
    return [F.col(c) for c in ORDER]


@query("e8_temporal_split_all", "SELECT event_id, rank AS time_rank, split FROM all_split")
def e8_all(spark, sf):
    rows = scored(spark, sf).select("event_id", *[c for c in ORDER if c != "event_id"])
    out, _ = sp.temporal_split(with_rank(rows, time_order(), "time_rank"), time_order())
    return out.select("event_id", "time_rank", "split")


@query("e8_temporal_split_real", "SELECT event_id, _source_type, split FROM real_split")
def e8_real(spark, sf):
    out, _ = sp.temporal_split(scored(spark, sf), time_order(), real_holdout=True)
    return out.select("event_id", "_source_type", "split")


@query(
    "e10_plain_split",
    """SELECT event_id, CASE WHEN rank < floor(n * 0.6) THEN 'train' WHEN rank < floor(n * 0.8) THEN 'val'
         ELSE 'test' END AS split FROM ranked, rank_size""",
)
def e10(spark, sf):
    return sp.plain_temporal_split(scored(spark, sf), time_order()).select("event_id", "split")


@query(
    "e9_lower_nearest_rank",
    """WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events)
       SELECT max(n) AS n, max(CASE WHEN r = floor(0.95 * (n - 1)) THEN value END) AS p95,
         max(CASE WHEN r = floor(0.99 * (n - 1)) THEN value END) AS p99 FROM v""",
)
def e9(spark, sf):
    return lower_quantiles(table(spark, sf, "events"), "value", {"p95": 0.95, "p99": 0.99})


@query(
    "e9_lower_nearest_rank_by_type",
    """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r,
         count(*) OVER (PARTITION BY event_type) AS n FROM events)
       SELECT event_type, max(n) AS n, max(CASE WHEN r = floor(0.5 * (n - 1)) THEN value END) AS p50,
         max(CASE WHEN r = floor(0.95 * (n - 1)) THEN value END) AS p95 FROM v GROUP BY event_type""",
)
def e9_by(spark, sf):
    return lower_quantiles(
        table(spark, sf, "events"), "value", {"p50": 0.5, "p95": 0.95}, ("event_type",)
    )


@query(
    "e11_cumulative_counts",
    """SELECT score, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_n AS BIGINT) AS cum_n FROM pr_steps""",
)
def e11(spark, sf):
    counted = scored(spark, sf).groupBy("score").agg(
        F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    steps = running_sums(counted, [F.col("score").desc()], {"cum_pos": "pos", "cum_n": "n"})
    return steps.select("score", "cum_pos", "cum_n")


@query(
    "g2_train_union",
    """SELECT _source_type, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS leaks FROM real_split
       WHERE split = 'train' GROUP BY 1""",
)
def g2(spark, sf):
    out, _ = sp.temporal_split(scored(spark, sf), time_order(), real_holdout=True)
    train = out.filter("split = 'train'")
    return train.groupBy("_source_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("y").cast("long")).alias("leaks")
    )


@query(
    "j8_stratified_split",
    """WITH u AS (SELECT event_id, y, {u:42:event_id} AS u FROM scored),
       c AS (SELECT y, count(*) AS m, sum(count(*)) OVER () AS n, ceil(sum(count(*)) OVER () * 0.2) AS n_test
             FROM u GROUP BY y),
       q AS (SELECT *, CAST(floor(m * n_test / n) AS BIGINT) AS whole,
               (CAST(m AS BIGINT) * CAST(n_test AS BIGINT)) % CAST(n AS BIGINT) AS rem FROM c),
       quota AS (SELECT y, whole + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= n_test - sum(whole) OVER ()
             THEN 1 ELSE 0 END AS quota FROM q)
       SELECT event_id, u.y, CASE WHEN row_number() OVER (PARTITION BY u.y ORDER BY u, event_id) <= quota
         THEN 'test' ELSE 'train' END AS split FROM u JOIN quota ON quota.y = u.y""",
)
def j8(spark, sf):
    rows = scored(spark, sf).select("event_id", "y")
    return sp.stratified_split(rows, "y", ["event_id"]).select("event_id", "y", "split")


@query(
    "j7_prior_baseline",
    """WITH p AS (SELECT avg(y) AS prior FROM all_split WHERE split = 'train')
       SELECT split, round(avg(prior), 6) AS prior,
         round(count(*) FILTER (WHERE y = 1) / count(*), 6) AS "precision",
         CASE WHEN count(*) FILTER (WHERE y = 1) > 0 THEN 1.0 ELSE 0.0 END AS recall,
         round(count(*) FILTER (WHERE y = 1) / count(*), 6) AS pr_auc
       FROM all_split, p WHERE split <> 'train' GROUP BY split""",
)
def j7(spark, sf):
    out, _ = sp.temporal_split(scored(spark, sf), time_order())
    prior = out.filter("split = 'train'").agg(F.avg("y").alias("prior"))
    held = out.filter("split <> 'train'").withColumn("prior", prior.scalar())
    # One score for every row, at its own threshold: every row is predicted positive.
    conf = held.groupBy("split").agg(
        F.avg("prior").alias("prior"),
        F.count_if(F.col("y") == 0).alias("fp"),
        F.lit(0).alias("fn"),
        F.count_if(F.col("y") == 1).alias("tp"),
    )
    scores = m.precision_recall_f1()
    constant = held.withColumn("score", F.col("prior"))
    return rounded(
        conf.join(m.average_precision(constant, ("split",)), "split").select(
            "split", "prior", scores["precision"].alias("precision"),
            scores["recall"].alias("recall"), "pr_auc",
        )
    )


@query(
    "j2_class_weights",
    """SELECT y, count(*) AS n_rows, round((SELECT count(*) FROM all_split WHERE split = 'train')
         / ((SELECT count(DISTINCT y) FROM all_split WHERE split = 'train') * count(*)), 6) AS weight
       FROM all_split WHERE split = 'train' GROUP BY y""",
)
def j2(spark, sf):
    from pipewatch.operators.models import class_weights

    out, _ = sp.temporal_split(scored(spark, sf), time_order())
    return rounded(class_weights(out.filter("split = 'train'"), "y").withColumnRenamed("rows", "n_rows"))


@query(
    "d37_data_sufficiency",
    """WITH a AS (SELECT count(*) FILTER (WHERE split = 'train') AS real_train_rows,
           count(*) FILTER (WHERE split = 'val') AS real_val_rows,
           count(*) FILTER (WHERE split = 'test') AS real_test_rows,
           count(*) FILTER (WHERE split = 'test' AND y = 1) AS real_test_leaks
         FROM real_split WHERE _source_type = 'real'),
       l AS (SELECT 'real_train_rows' AS requirement, CAST(200 AS BIGINT) AS minimum, real_train_rows AS actual FROM a
         UNION ALL SELECT 'real_val_rows', 30, real_val_rows FROM a
         UNION ALL SELECT 'real_test_rows', 100, real_test_rows FROM a
         UNION ALL SELECT 'real_test_leaks', 10, real_test_leaks FROM a)
       SELECT *, greatest(minimum - actual, 0) AS gap, actual >= minimum AS ok,
         (SELECT bool_and(actual >= minimum) FROM l) AS ready FROM l""",
)
def d37(spark, sf):
    out, _ = sp.temporal_split(scored(spark, sf), time_order(), real_holdout=True)
    return sp.data_sufficiency(out, "y")


@query(
    "d38_split_profile",
    """SELECT split, count(*) AS "rows", count(*) FILTER (WHERE _source_type = 'real') AS real_rows,
         count(*) FILTER (WHERE _source_type <> 'real') AS synthetic_rows,
         count(*) FILTER (WHERE _source_type = 'real' AND y = 1) AS real_leaks
       FROM real_split GROUP BY split""",
)
def d38(spark, sf):
    out, _ = sp.temporal_split(scored(spark, sf), time_order(), real_holdout=True)
    return sp.split_profile(out, "y")


@query(
    "d40_complexity_rules",
    """WITH f AS (SELECT count(*) AS n, count(DISTINCT sensor_node_id) AS s FROM gold_rows)
       SELECT 'autoencoder' AS model, n >= 5000 AS justified, CASE WHEN n >= 5000
           THEN 'High-dimensional, large-sample anomaly learning possible'
           ELSE 'Not enough rows/features for stable autoencoder training' END AS reason,
         n AS "rows", s AS sensors, false AS trained FROM f
       UNION ALL SELECT 'lstm', n >= 8000, CASE WHEN n >= 8000 THEN 'Sufficient temporal volume for sequence modeling'
           ELSE 'Temporal sample volume too small for robust LSTM' END, n, s, false FROM f
       UNION ALL SELECT 'gnn', s >= 25 AND n >= 5000, CASE WHEN s >= 25 AND n >= 5000
           THEN 'Topology-aware learning likely beneficial'
           ELSE 'Topology coverage/scale does not justify GNN complexity' END, n, s, false FROM f""",
)
def d40(spark, sf):
    from pipewatch.operators.models import candidate_features

    gold = gold_frame(spark, sf)
    return m.complexity_rules(gold, len(candidate_features(gold)))


@query(
    "d41_fingerprint",
    """WITH h AS (SELECT CAST(concat('0x', substr(md5(concat_ws('|', event_id, user_id, event_type,
           coalesce(props, '~'), strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), coalesce(CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR), '~'))), 1, 8)) AS BIGINT) AS h FROM events)
       SELECT count(*) AS "rows", CAST(sum(h) AS BIGINT) AS hash_sum, bit_xor(h) AS hash_xor FROM h""",
)
def d41(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "props",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.round(F.col("value") * 1e6).cast("long").alias("micro_value"),
    )
    return m.fingerprint(events, events.columns)


CTES["green_scores"] = """
    SELECT event_id, round(least(1.0, score + 0.1 * {u:5:event_id}), 4) AS score FROM scored
    WHERE _source_type = 'real'"""
CTES["blue_green"] = """
    SELECT coalesce(b.event_id, g.event_id) AS event_id, b.score AS blue, g.score AS green,
      abs(b.score - g.score) AS delta, b.score IS NOT NULL AND g.score IS NOT NULL AS matched
    FROM scored b FULL JOIN green_scores g ON b.event_id = g.event_id"""


def blue_green(spark, sf):
    from pipewatch.functions.expr import uniform

    blue = scored(spark, sf)
    moved = F.col("score") + F.lit(0.1) * uniform(5, "event_id")
    green = blue.filter("_source_type = 'real'").withColumn(
        "score", F.round(F.least(F.lit(1.0), moved), 4)
    )
    return m.score_deltas(blue, green, "event_id")


@query(
    "c5_blue_green_pairs",
    "SELECT event_id, blue, green, round(delta, 6) AS delta, matched FROM blue_green",
)
def c5(spark, sf):
    return rounded(blue_green(spark, sf))


@query(
    "d42_blue_green_delta",
    """SELECT count(*) FILTER (WHERE matched) AS n_rows, count(*) FILTER (WHERE NOT matched) AS mismatched_rows,
         round(max(delta), 6) AS max_score_delta, round(avg(delta), 6) AS mean_score_delta FROM blue_green""",
)
def d42(spark, sf):
    return rounded(m.delta_summary(blue_green(spark, sf)))
