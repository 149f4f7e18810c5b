"""Streaming jobs: twins agree, restarts do not repeat, limits hold."""

import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from pipewatch.sources.scratch import scratch_path
from pipewatch.streaming import landing, limits


def brute_limit(calls, limit, window):
    logs, out = {}, []
    for client, at, seq in sorted(calls, key=lambda c: (c[1], c[2])):
        log = logs.setdefault(client, deque())
        while log and log[0] < at - window:
            log.popleft()
        ok = len(log) < limit
        if ok:
            log.append(at)
        out.append((client, at, seq, ok))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def calls():
    rng = np.random.default_rng(9)
    client = np.where(rng.random(600) < 0.5, "hot", rng.choice(["a", "b", "c"], 600))
    at = np.sort(rng.integers(0, 3_000, 600)) * 1_000_000
    return [(c, int(t), i) for i, (c, t) in enumerate(zip(client, at))]


@pytest.mark.parametrize("limit, window", [(1, 60), (3, 20), (60, 60)])
def test_rate_limit_table(spark, limit, window):
    df = spark.createDataFrame(calls(), "client string, at_micros long, seq long")
    assert rows_of(limits.limit_table(df, limit, window)) == brute_limit(calls(), limit, window * 1_000_000)


def test_rate_limit_table_with_a_hot_client(spark, split_hot_keys):
    df = spark.createDataFrame(calls(), "client string, at_micros long, seq long")
    assert rows_of(limits.limit_table(df, 2, 10)) == brute_limit(calls(), 2, 10_000_000)


def test_second_call_is_rejected(spark):
    df = spark.createDataFrame([("c", 0, 1), ("c", 60_000_000, 2), ("c", 120_000_001, 3)], "client string, at_micros long, seq long")
    got = limits.limit_table(df, 1, 60).orderBy("seq").collect()
    assert [r["accepted"] for r in got] == [True, False, True]


def test_stream_equals_table_over_restarts(spark, tmp_path):
    source, target, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "client string, at_micros long, seq long"
    for part in np.array_split(np.array(calls(), dtype=object), 3):
        rows = [(c, int(t), int(s)) for c, t, s in part]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        limits.answer_calls(stream, target, check, limit=3, window_seconds=20).awaitTermination(60)
    assert rows_of(spark.read.parquet(target)) == brute_limit(calls(), 3, 20_000_000)


def test_landing_once_per_event(spark, tmp_path):
    source = tmp_path / "feed"
    source.mkdir()
    good, bad, check = (str(tmp_path / n) for n in ("good", "bad", "check"))
    for k in range(2):
        (source / f"{k}.json").write_text(f'{{"id": {k}}}\n\n{{"id": \n[1]\nnull\n')
        landing.land_with_quarantine(landing.text_source(spark, str(source)), good, bad, check).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(good).select("value").collect()) == ['{"id": 0}', '{"id": 1}']
    assert spark.read.text(bad).count() == 6


def test_landing_folders(spark, tmp_path):
    source = tmp_path / "feed"
    source.mkdir()
    (source / "a.json").write_text('{"id": 1}\n')
    target = str(tmp_path / "landed")
    at = F.lit("2024-03-05 10:00:00").cast("timestamp")
    landing.land_events(landing.text_source(spark, str(source)), target, str(tmp_path / "c"), at).awaitTermination()
    assert (tmp_path / "landed" / "year=2024" / "month=03" / "day=05").is_dir()


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_admit_keeps_accepted_calls_only():
    log = deque()
    assert [limits.admit(log, t, 10, 2) for t in (0, 5, 6, 11, 12)] == [True, True, False, True, False]
    assert list(log) == [5, 11]


def test_state_of_idle_clients_expires(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "client string, at_micros long, seq long"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert limits.answer_calls(stream, target, check, limit=3, window_seconds=20, idle_seconds=2).awaitTermination(60)
        held = spark.read.format("statestore").option("stateVarName", "accepted").load(check)
        return {r[0] for r in held.select("key.*").collect()}

    assert run([("idle", 0, 1), ("busy", 0, 2)]) == {"idle", "busy"}
    time.sleep(3)
    assert run([("busy", 30_000_000, 3)]) == {"busy"}
