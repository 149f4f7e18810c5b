"""Model training, scoring and ledger queries over the gold features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog import metrics as mc
from pipewatch.catalog.medallion import gold_frame
from pipewatch.catalog.registry import CTES, query
from pipewatch.catalog.scenarios import payload_rows
from pipewatch.functions.expr import rounded
from pipewatch.operators import metrics as m
from pipewatch.operators import models as mm
from pipewatch.operators import splits as sp
from pipewatch.operators.isolation import fit_isolation_forest, raw_anomaly, scaled_scores
from pipewatch.plans import store
from pipewatch.plans import training as tr
from pipewatch.sources.schemas import MODEL_FEATURES
from pipewatch.sources.scratch import checkpointed, scratch_path
from pipewatch.sources.views import table, view
from pipewatch.streaming.service import score_requests

FEATURES = list(MODEL_FEATURES)

CTES["gold_split"] = """
    SELECT g.*, CASE WHEN place < greatest(2, floor(n * 0.6)) THEN 'train'
        WHEN place < least(n - 1, greatest(greatest(2, floor(n * 0.6)) + 1, floor(n * 0.8))) THEN 'val'
        ELSE 'test' END AS split
    FROM gold_ranked g, (SELECT count(*) AS n FROM gold_rows)"""


def split_gold(spark, sf):
    keep = [*tr.ORDER, tr.LABEL, "_source_type", *FEATURES]
    split, _ = sp.temporal_split(checkpointed(gold_frame(spark, sf).select(*keep)), tr.order_columns())
    return split


def parts(spark, sf):
    split = split_gold(spark, sf)
    return split.filter("split = 'train'"), split.filter("split = 'test'")


def scored_test(model, test):
    out = mm.score_with(model, test, FEATURES)
    return rounded(out.select(*tr.ORDER, F.col(tr.LABEL).alias("y"), "score"))


@query(
    "j1_standard_scaling",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(avg({f}), 4) AS mean,
            round(CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END, 4) AS scale
            FROM gold_split WHERE split = 'train'"""
        for f in FEATURES
    ),
)
def j1(spark, sf):
    train, _ = parts(spark, sf)
    return rounded(mm.scaler_stats(train, FEATURES), 4)


@query("j3_isolation_forest")
def j3(spark, sf):
    train, test = parts(spark, sf)
    fitted = tr.fit_isolation(train, FEATURES)
    return rounded(fitted.score(test).select(*tr.ORDER, "score"))


@query("j4_random_forest")
def j4(spark, sf):
    train, test = parts(spark, sf)
    return scored_test(mm.fit_random_forest(train, FEATURES, tr.LABEL), test)


@query("j5_boosted_trees")
def j5(spark, sf):
    train, test = parts(spark, sf)
    return scored_test(mm.fit_boosted_trees(train, FEATURES, tr.LABEL), test)


@query("j6_logistic_baseline")
def j6(spark, sf):
    keep = [*tr.ORDER, tr.LABEL, *FEATURES]
    scored = tr.logistic_baseline(gold_frame(spark, sf).select(*keep))
    return rounded(scored.select("model", "split", *tr.ORDER, "y", "score"))


def stored_model(spark, sf):
    """A forest fitted on the train split, written and read back as tables; of one class only, an isolation forest."""
    train, _ = parts(spark, sf)
    fitted = tr.supervised("random_forest", train, FEATURES, mm.fit_random_forest)
    path = scratch_path(spark, "model")
    store.save_model(fitted if fitted.score else tr.fit_isolation(train, FEATURES), path)
    return store.load_model(spark, path)


@query("j10_batch_scoring")
def j10(spark, sf):
    return rounded(tr.score_batches(payload_rows(spark, sf), stored_model(spark, sf)))


@query(
    "j10_stream_scoring",
    """SELECT batch_id, row_index, 11 AS feature_count, true AS is_share, true AS flag_follows
       FROM payload_errors JOIN payload_batches USING (batch_id) WHERE accepted""",
)
def j10_stream(spark, sf):
    """Streamed requests scored from the stored model: which rows are answered, and what every answer must hold."""
    landed, target = scratch_path(spark, "requests"), scratch_path(spark, "answers")
    messages = payload_rows(spark, sf).groupBy("batch_id").agg(F.collect_list(F.struct("row_index", "payload")).alias("rows"))
    messages.write.parquet(landed)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 8).parquet(landed)
    score_requests(stream, stored_model(spark, sf), target, scratch_path(spark, "state")).awaitTermination()
    answers = spark.read.parquet(target)
    return answers.select(
        "batch_id", "row_index", "feature_count", F.col("score").between(0, 1).alias("is_share"),
        (F.col("is_leak") == (F.col("score") >= 0.5).cast("int")).alias("flag_follows"),
    )


def stressed(spark, sf):
    keep = [*tr.ORDER, "leak_label", *FEATURES]
    return tr.stress_model(gold_frame(spark, sf).select(*keep), stored_model(spark, sf))


@query("j13_scenario_results")
def j13(spark, sf):
    results, _ = stressed(spark, sf)
    return rounded(results.drop("model"))


@query("d39_generalization")
def d39(spark, sf):
    _, overall = stressed(spark, sf)
    return rounded(overall)


@query("j3_embedding_anomalies")
def j3_embeddings(spark, sf):
    """An isolation forest over the 64 numbers of each embedding, scaled over the table."""
    width = 64
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(width)]
    )
    names = [f"x{i}" for i in range(width)]
    forest = fit_isolation_forest(rows, names, [F.col("vec_id")], n_trees=300)
    return rounded(scaled_scores(rows, forest).select("vec_id", "label", "score"))


_KEYS = [
    "tn", "fp", "fn", "tp", "precision", "recall", "f1", "pr_auc", "business_cost_missed_leaks",
    "business_cost_false_alarms", "business_value_early_detection", "business_net_value",
]


@query(
    "j16_run_ledger",
    " UNION ALL ".join(
        f"""SELECT 'run-1' AS run_id, model, 'metric' AS kind, '{k}' AS key, round(CAST("{k}" AS DOUBLE), 6) AS value
            FROM model_table"""
        for k in _KEYS
    )
    + """ UNION ALL SELECT 'run-1', model, 'parameter', 'threshold_default', 0.5 FROM model_table
         UNION ALL SELECT 'run-1', model, 'parameter', 'cost_missed_leak', 5000.0 FROM model_table""",
)
def j16(spark, sf):
    models = m.model_metrics(view(spark, sf, "model_scores"))
    parameters = {"threshold_default": 0.5, "cost_missed_leak": 5000.0}
    rows = tr.run_ledger(models, "run-1", parameters)
    return rounded(tr.append_ledger(rows, scratch_path(spark, "ledger")))


@query("j15_lineage_record")
def j15(spark, sf):
    best = m.select_candidate(m.model_metrics(view(spark, sf, "model_scores")))
    parameters = {"threshold_default": 0.5, "cost_missed_leak": m.COST_MISSED_LEAK}
    record = tr.lineage(best, gold_frame(spark, sf), parameters)
    return rounded(tr.append_ledger(record, scratch_path(spark, "lineage")))


@query(
    "j9_single_class_guard",
    """SELECT split, count(DISTINCT y) > 1 AS trainable FROM all_split GROUP BY split""",
)
def j9(spark, sf):
    out, _ = sp.temporal_split(mc.scored(spark, sf), mc.time_order())
    return out.groupBy("split").agg((F.min("y") != F.max("y")).alias("trainable"))
