"""Faults that the checking SQL did not see."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from pipewatch.operators import evidence as ev
from pipewatch.operators import gates as g
from pipewatch.operators import ordered as o
from pipewatch.operators import scenarios as sc
from pipewatch.operators import silver as sv
from pipewatch.plans import operations as op
from pipewatch.plans import training as tr
from pipewatch.streaming import service


def test_ranks_do_not_depend_on_file_lengths(spark):
    df = spark.range(2600).select((F.col("id") * 7919 % 2600).alias("v"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        got = rows_of(o.with_rank(df, [F.col("v")]))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == sorted(((i, i) for i in range(2600)), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_a_sensor_of_many_incident_starts(spark, split_hot_keys):
    base = datetime(2024, 1, 1)
    readings = spark.createDataFrame([(base + timedelta(minutes=i * 200), "S", 0) for i in range(5)], "event_ts_utc timestamp, sensor_node_id string, leak_label int")
    leaks = spark.createDataFrame([(f"i{i}", "S", str(base + timedelta(minutes=i)), str(base + timedelta(minutes=i))) for i in range(1000) if i != 400], "incident_id string, node_id string, start_time string, end_time string")
    got = sv.align_labels(readings, leaks).orderBy("event_ts_utc").collect()
    assert [r.leak_label_aligned for r in got] == [1, 1, 0, 1, 1]


def test_windows_whose_events_were_all_late_are_reported(spark):
    base = datetime(2024, 1, 1)
    log = spark.createDataFrame([(base, 200), (base + timedelta(minutes=20), 200), (base + timedelta(minutes=90), 500)], "ts timestamp_ntz, status_code int")
    closed = spark.createDataFrame([(base, 1)], "window_start timestamp, requests long")
    got = service.late_events(closed, log).orderBy("window_start").collect()
    assert [(r.arrived, r.counted, r.late) for r in got] == [(1, 1, 0), (1, 0, 1)]


def test_cases_without_hits_count(spark):
    cases = spark.createDataFrame([(1, ["a"], ["x"], ["y"]), (2, ["a"], ["x"], ["y"])], "incident_id long, expected_sources array<string>, expected_phrases array<string>, blocked_phrases array<string>")
    produced = spark.createDataFrame([(1, ["a"], ["c"], "x here", "do")], "incident_id long, sources array<string>, citations array<string>, rationale string, suggested_response string")
    quality = ev.retrieval_quality(cases, produced)
    assert rows_of(quality) == [(1, 1.0, True, False, True, 1), (2, 0.0, False, False, False, 0)]
    roll = ev.quality_rollup(quality).first()
    assert (roll.cases, roll.grounded_rate, roll.citation_rate) == (2, 0.5, 0.5)


def test_gates_do_not_pass_on_nothing(spark):
    empty = spark.createDataFrame([], "subject string, metric string, value double")
    checks = g.evaluate_gate(empty, g.DEPLOYMENT_GATE, ("candidate",))
    assert checks.count() == len(g.DEPLOYMENT_GATE) and checks.filter("passed").count() < len(g.DEPLOYMENT_GATE)
    with pytest.raises(RuntimeError):
        op.require(g.evaluate_gate(empty, g.DEPLOYMENT_GATE), "deployment gate")


def test_anomaly_scores_of_a_batch_do_not_depend_on_others(spark):
    rng = np.random.default_rng(1)
    names = list(tr.inf.MODEL_FEATURES)
    train = spark.createDataFrame(pd.DataFrame({**{n: rng.normal(size=200) for n in names}, tr.LABEL: 0, **{k: (np.arange(200) if i else pd.Timestamp("2024-01-01")) for i, k in enumerate(tr.ORDER)}}))
    fitted = tr.fit_isolation(train, names, n_trees=8)
    batch = lambda b, scale: [(b, i, *map(float, rng.normal(size=len(names)) * scale)) for i in range(20)]
    rows = spark.createDataFrame(batch("a", 1) + batch("b", 40), ["batch_id", "row_index", *names])
    both = fitted.score(rows, ("batch_id",)).groupBy("batch_id").agg(F.max("score").alias("top"), F.min("score").alias("low")).collect()
    assert [(r.top, r.low) for r in both] == [(1.0, 0.0)] * 2


def test_synthetic_readings_draw_once(spark):
    """Missing and negative measures as before, and no draw twice in the plan: the draws are most of the work."""
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), None if i % 3 == 0 else -1.0 if i % 3 == 1 else 5.0, 2.0, 3.0, i % 2) for i in range(9)]
    seeds = spark.createDataFrame(rows, "event_id long, timestamp timestamp, pressure double, flow double, demand double, leak_label int")
    out = sc.augment(seeds, [F.col("event_id")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"md5(cast(concat_ws(:, 42:{m}{half}") for m in sc.MEASURES for half in "ab"] == [1] * 6
    got = out.collect()
    assert len(got) == 360
    for r in got:
        assert (r.pressure is None) == (r.event_id % 3 == 0) and r.flow is not None and r.demand is not None
        assert r.event_id % 3 != 1 or r.pressure == 0.0
