"""Evaluation, monitoring, inference checks and models against brute force."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pipewatch.operators import alerts as al
from pipewatch.operators import inference as inf
from pipewatch.operators import isolation as iso
from pipewatch.operators import metrics as m
from pipewatch.operators import models as mm
from pipewatch.operators import monitoring as mo
from pipewatch.operators import splits as sp
from pipewatch.plans import training as tr
from pipewatch.sources.readers import read_jsonl_maps, read_knowledge, read_prediction_log
from pipewatch.sources.schemas import MODEL_FEATURES


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    n = 300
    y = (rng.random(n) < 0.3).astype(int)
    score = np.round(0.6 * rng.random(n) + 0.4 * y, 2)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 20, unit="m")
    pdf = pd.DataFrame({"id": np.arange(n), "ts": ts, "y": y, "score": score})
    return pdf, spark.createDataFrame(pdf)


def brute(pdf, t):
    y, s = pdf.y.to_numpy(), pdf.score.to_numpy()
    p = (s >= t).astype(int)
    tp, fp = int(((y == 1) & (p == 1)).sum()), int(((y == 0) & (p == 1)).sum())
    fn, tn = int(((y == 1) & (p == 0)).sum()), int(((y == 0) & (p == 0)).sum())
    delays = []
    for i in np.where(y == 1)[0]:
        later = np.where(p[i:] == 1)[0]
        delays.append(later[0] if len(later) else len(p) - i)
    days = max((pdf.ts.max() - pdf.ts.min()).total_seconds() / 86400, 1.0)
    ap, seen = 0.0, 0
    for v in sorted(set(s), reverse=True):
        at = s >= v
        hits = int(y[at].sum())
        ap += (hits - seen) / y.sum() * hits / at.sum()
        seen = hits
    return dict(
        tn=tn, fp=fp, fn=fn, tp=tp, precision=tp / (tp + fp) if tp + fp else 0.0, recall=tp / (tp + fn),
        pr_auc=ap, detection_delay_steps=float(np.mean(delays)), false_alarm_frequency_per_day=fp / days if fp else 0.0,
        business_net_value=2500.0 * tp - 5000.0 * fn - 500.0 * fp,
    )


def test_sweep(scored):
    pdf, df = scored
    rows = {round(r["threshold"], 2): r for r in m.sweep(df, ["ts", "id"]).collect()}
    assert len(rows) == 17
    for t in (0.1, 0.35, 0.5, 0.9):
        for name, value in brute(pdf, t).items():
            assert rows[t][name] == pytest.approx(value), (t, name)
    assert m.evaluate(df, ["ts", "id"]).first()["f1"] == pytest.approx(rows[0.5]["f1"])


def test_no_positives(spark):
    df = spark.createDataFrame([(1, 0, 0.4), (2, 0, 0.9)], "id long, y int, score double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    r = m.evaluate(df, ["id"]).first()
    assert (r["pr_auc"], r["detection_delay_steps"], r["recall"], r["false_alarm_frequency_per_day"]) == (0.0, 0.0, 0.0, 1.0)


def test_calibration(scored):
    pdf, df = scored
    edges = np.percentile(pdf.score, np.linspace(0, 100, 9))
    bins = np.searchsorted(edges[1:-1], pdf.score)
    want = pdf.assign(b=bins).groupby("b").agg(t=("y", "mean"), p=("score", "mean"))
    got = m.calibration_curve(df).orderBy("bin").toPandas()
    assert np.allclose(got.prob_true, want.t) and np.allclose(got.prob_pred, want.p)
    error = m.calibration_error(m.calibration_curve(df)).first()[0]
    assert error == pytest.approx(np.abs(want.t - want.p).mean())


def test_cut_points_and_fallback(spark):
    assert sp.cut_points(5, 0.6, 0.2) == (3, 4)
    assert sp.cut_points(37, 0.6, 0.2) == (22, 29)
    df = spark.createDataFrame([(i, "real" if i < 3 else "synthetic") for i in range(9)], "t long, _source_type string")
    out, policy = sp.temporal_split(df, [F.col("t")], real_holdout=True)
    assert policy == "temporal_all_fallback"
    assert [r["split"] for r in out.orderBy("t").collect()] == ["train"] * 5 + ["val"] * 2 + ["test"] * 2
    with pytest.raises(ValueError):
        sp.temporal_split(df.limit(4), [F.col("t")])


def test_stratified_split_keeps_shares(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "id long, y int")
    out = sp.stratified_split(df, "y", ["id"]).filter("split = 'test'").groupBy("y").count()
    assert {r["y"]: r["count"] for r in out.collect()} == {0: 15, 1: 5}
    few = spark.createDataFrame([(i, int(i == 0)) for i in range(10)], "id long, y int")
    assert sp.stratified_split(few, "y", ["id"]).filter("split = 'test'").count() == 4


def psi(base, curr):
    low, high = min(base + curr), max(base + curr)
    width = (high - low) / 10
    total = 0.0
    for b in range(10):
        def share(vals):
            return max(sum(min(int((v - low) / width), 9) == b for v in vals) / len(vals), 1e-9)

        total += (share(curr) - share(base)) * math.log(share(curr) / share(base))
    return total


def test_psi(spark):
    rng = np.random.default_rng(4)
    base, curr = rng.normal(0, 1, 200).tolist(), rng.normal(0.5, 1, 150).tolist()
    rows = [("f", "baseline", v) for v in base] + [("f", "current", v) for v in curr]
    rows += [("same", s, v) for v in base for s in ("baseline", "current")]
    rows += [("flat", s, 1.0) for s in ("baseline", "current")] + [("one", "baseline", 1.0), ("one", "baseline", 2.0)]
    got = {r["feature"]: r["psi"] for r in mo.psi_by_feature(spark.createDataFrame(rows, "feature string, side string, value double")).collect()}
    assert got["f"] == pytest.approx(psi(base, curr))
    assert got["same"] == pytest.approx(0.0) and got["flat"] == 0.0 and got["one"] == 0.0


def maps(spark, tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    return read_jsonl_maps(spark, str(path))


def test_row_quality_and_schema_changes(spark, tmp_path):
    rows = maps(spark, tmp_path, "a", [{"a": 1, "b": None}, {"b": None, "a": 1}, {"a": 2, "b": 4}])
    r = mo.row_quality(rows).first()
    assert (r["missing_rate"], r["duplicate_rate"]) == (pytest.approx(2 / 6), pytest.approx(1 / 3))
    before, now = maps(spark, tmp_path, "b", [{"a": 1, "b": 2}]), maps(spark, tmp_path, "c", [{"a": 1, "c": 3}])
    assert {tuple(x) for x in mo.schema_changes(before, now).collect()} == {("added", "c"), ("removed", "b")}


def test_missing_files(spark, tmp_path):
    assert read_prediction_log(spark, str(tmp_path / "no")).count() == 0
    empty = mo.row_quality(read_jsonl_maps(spark, str(tmp_path / "no"))).first()
    assert (empty["missing_rate"], empty["duplicate_rate"]) == (0.0, 0.0)
    (tmp_path / "k").write_text("")
    with pytest.raises(ValueError):
        read_knowledge(spark, str(tmp_path / "k"))


def test_missing_status_counts_both_ways(spark):
    df = spark.createDataFrame([(None,), (200,), (404,), (500,)], "status_code int")
    r = df.agg(mo.SERVICE["error_rate"]().alias("e"), mo.SERVICE["availability"]().alias("a")).first()
    assert (r["e"], r["a"]) == (0.5, 0.5)


def test_sustained_breach_needs_an_unbroken_run(spark):
    minutes = [0, 1, 2, 4, 5] + list(range(10, 22))
    df = spark.createDataFrame([(f"2024-01-01 00:{i:02d}:00", 1200.0 if i in minutes else 10.0) for i in range(30)], "t string, p95_latency_ms double")
    periods = df.withColumn("period_start", F.col("t").cast("timestamp")).withColumns(
        {c: F.lit(None).cast("double") for c in ("availability", "p99_latency_ms", "error_rate_5xx", "cpu_percent", "memory_percent")}
    )
    got = al.sustained_breaches(periods).collect()
    assert [(r["rule"], r["severity"], r["periods"]) for r in got] == [("p95_latency_high", "warning", 12)]


def payload(spark, *rows):
    return spark.createDataFrame([(b, i, t) for i, (b, t) in enumerate(rows)], "batch_id long, row_index long, payload string")


def whole(**changes):
    return json.dumps({**{f: 1.5 for f in MODEL_FEATURES}, **changes})


def test_inference_rows(spark):
    short = json.dumps({f: 1 for f in MODEL_FEATURES if f != "flow"})
    rows = payload(
        spark, (1, whole()), (1, json.dumps([1.0] * 11)), (2, short), (2, whole(flow="abc")), (2, json.dumps([1.0] * 10)),
        (2, whole(flow=None)), (2, whole(demand="NaN")), (2, "7"), (3, whole(flow="2.5")),
    )
    got = inf.validate_rows(rows)
    errors = {r["row_index"]: r["error"] for r in got.collect()}
    assert errors[0] is errors[1] is errors[8] is None
    assert errors[2] == "Row 2 missing fields: ['flow']"
    assert errors[3].endswith("non-numeric feature values") and errors[5].endswith("non-numeric feature values")
    assert errors[4] == "Row 4 must contain 11 feature values"
    assert errors[6].endswith("NaN or infinite values") and errors[7].endswith("must be an object or list")
    assert {r["batch_id"]: r["accepted"] for r in inf.batch_verdicts(got).collect()} == {1: True, 2: False, 3: True}
    assert inf.accepted_rows(got).count() == 3
    assert not any(r["accepted"] for r in inf.batch_verdicts(got, max_rows=0).collect())
    assert inf.validate_rows(payload(spark, (1, whole())).limit(0)).count() == 0


def test_average_path():
    assert iso.average_path(1) == 0 and iso.average_path(2) == 1
    assert iso.average_path(256) == pytest.approx(2 * (math.log(255) + iso.EULER) - 2 * 255 / 256)


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(0, 1, (400, 3)), columns=["a", "b", "c"])
    pdf.loc[17] = [12.0, -9.0, 11.0]
    pdf["id"] = np.arange(400)
    df = spark.createDataFrame(pdf)
    forest = iso.fit_isolation_forest(df, ["a", "b", "c"], [F.col("id")], n_trees=60)
    assert forest.sample == 256 and len(forest.trees) == 60
    got = iso.scaled_scores(df, forest).toPandas()
    assert got.loc[got.score.idxmax(), "id"] == 17
    assert (got.score.min(), got.score.max()) == (0.0, 1.0)


def test_single_class_is_skipped(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, target_leak_horizon int")
    fitted = tr.supervised("random_forest", df, ["x"], mm.fit_random_forest)
    assert fitted.score is None and fitted.reason == mm.SINGLE_CLASS


def test_leakage_guard():
    assert mm.leaking_features(["flow", "Target_x", "future_flow"]) == ["Target_x", "future_flow"]


def test_training_run(spark, sf):
    from pipewatch.catalog.medallion import gold_frame
    from pipewatch.sources.scratch import checkpointed

    gold = checkpointed(gold_frame(spark, sf))
    suite = tr.train_suite(gold, real_holdout=True, isolation_trees=20, forest_trees=10, boosting_rounds=3)
    assert suite.policy == "real_only_holdout"
    assert suite.metrics.count() == 6 and suite.sweeps.count() == 51 and suite.skipped.count() == 0
    assert suite.gate.count() == 24
    assert suite.scored.agg(F.min("score"), F.max("score")).first()[0] >= 0.0
    results, overall = tr.stress_test(gold, suite, rows=60)
    assert results.count() == 12
    assert results.filter("status = 'handled'").first()["f1"] is None
    chosen = tr.select_candidate(suite, gold, overall).first()
    assert chosen["model"] in suite.models and len(chosen["feature_version"]) == 64
    with pytest.raises(RuntimeError):
        tr.train_suite(
            gold, isolation_trees=5, forest_trees=2, boosting_rounds=1, enforce_data_sufficiency=True,
            minimums={**sp.MINIMUMS, "real_test_leaks": 10**6},
        )
    simple = tr.train_simple(gold, n_trees=5)
    assert 0 < simple.count() < gold.count()
