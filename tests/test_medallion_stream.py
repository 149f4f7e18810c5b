"""The tables kept up to date batch by batch against those built at once."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from pipewatch.operators import gold as go
from pipewatch.operators import silver as sv
from pipewatch.streaming import medallion as me

BRONZE = (
    "timestamp string, node_id string, pressure double, flow double, demand double, leak_label int, pressure_unit string, "
    "flow_unit string, demand_unit string, _ingest_ts timestamp, _source_file string, _source_type string, _row_hash string"
)
START = datetime(2024, 3, 1)


def reading(minute, node, value, source="real", arrived=0, pressure=None):
    at = START + timedelta(minutes=minute)
    p = value if pressure is None else pressure
    return (str(at), node, p, value * 2, value * 3, int(value) % 3 == 0, "psi", "gpm", None, at + timedelta(seconds=arrived), "f", source, f"{node}:{minute}:{value}:{arrived}")


def deliveries(seed=1, batches=4):
    """Readings of a hot sensor and two others with copies and bad rows, each batch a quarter of the time."""
    rng = random.Random(seed)
    out = []
    for b in range(batches):
        rows = []
        for minute in range(b * 60, b * 60 + 60, 5):
            for node in ["hot", "hot", rng.choice(["a", "b"])]:
                rows.append(reading(minute, node, float(rng.randint(1, 90)), rng.choice(["real", "synthetic"]), rng.randint(0, 50)))
            if rng.random() < 0.3:
                rows.append(reading(minute, rng.choice(["hot", "unknown"]), 5.0, pressure=rng.choice([-1.0, None])))
        if b:  # a better copy of a reading of the batch before, within the time allowed
            rows.append(reading(b * 60 - 5, "hot", 77.0, "real", -30))
        out.append([(*r[:5], int(r[5]), *r[6:]) for r in rows])
    return out


def tables_of(spark, tmp_path, **settings):
    nodes = spark.createDataFrame([("hot",), ("a",), ("b",)], "node_id string")
    metadata = spark.createDataFrame(
        [("i", "hot", str(START + timedelta(minutes=20)), str(START + timedelta(minutes=130)))], "incident_id string, node_id string, start_time string, end_time string"
    )
    links = spark.createDataFrame([("hot", "a"), ("hot", "hot")], "from_node string, to_node string")
    return me.Medallion(str(tmp_path / "m"), nodes, metadata, links, **settings)


def comparable(df):
    return rows_of(df.select(*sorted(df.columns)).withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"}))


@pytest.mark.parametrize("horizon", [1, 3])
def test_tables_equal_those_built_at_once(spark, tmp_path, horizon):
    tables = tables_of(spark, tmp_path, allowed=600, horizon=horizon)
    batches = [spark.createDataFrame(rows, BRONZE) for rows in deliveries()]
    for number, batch in enumerate(batches):
        me.advance(tables, batch, number)
        if number == 2:  # run again after a failure
            me.advance(tables, batch, number)
    kept = os.listdir(tmp_path / "m" / "state")
    assert len([k for k in kept if k.startswith("pool")]) == 2
    me.close(spark, tables)
    everything = batches[0]
    for batch in batches[1:]:
        everything = everything.unionByName(batch)
    silver = sv.silver(everything, tables.nodes, tables.metadata)
    assert comparable(me.read_table(spark, tables, "silver")) == comparable(silver)
    assert comparable(me.read_table(spark, tables, "gold")) == comparable(go.gold(silver, tables.links, horizon))
    rejected = sv.quarantined(everything, tables.nodes, tables.metadata)
    assert comparable(me.read_table(spark, tables, "rejected")) == comparable(rejected)
    assert me.read_table(spark, tables, "late").count() == 0


def test_a_reading_later_than_allowed_is_set_aside(spark, tmp_path):
    tables = tables_of(spark, tmp_path, allowed=600)
    on_time = [reading(m, "a", 9.0) for m in (0, 30)]
    late = [reading(5, "a", 7.0), reading(29, "a", 8.0)]
    fix = lambda rows: [(*r[:5], int(r[5]), *r[6:]) for r in rows]
    me.advance(tables, spark.createDataFrame(fix(on_time), BRONZE), 0)
    assert me.read_table(spark, tables, "silver").count() == 1 and me.read_table(spark, tables, "gold").count() == 0
    me.advance(tables, spark.createDataFrame(fix(late), BRONZE), 1)
    me.close(spark, tables)
    assert [r.event_ts_utc.minute for r in me.read_table(spark, tables, "late").collect()] == [5]
    assert [r.event_ts_utc.minute for r in me.read_table(spark, tables, "silver").orderBy(sv.TIME).collect()] == [0, 29, 30]
    gold = me.read_table(spark, tables, "gold").orderBy(sv.TIME).collect()
    assert [r.pressure_lag_1 for r in gold] == [0.0, 9.0, 8.0]


def test_features_and_neighbours_take_one_pass(spark, tmp_path, monkeypatch):
    """New rows are put in order once, for their features and for what is known of their neighbours."""
    calls = []
    real = go.over_series
    monkeypatch.setattr(go, "over_series", lambda *a, **k: calls.append(k) or real(*a, **k))
    rows = [("a", START + timedelta(minutes=m), float(m), 1.0, 2.0, m % 2) for m in range(12)]
    df = spark.createDataFrame(rows, f"{sv.SENSOR} string, {sv.TIME} timestamp, pressure_psi double, flow_gpm double, demand_gpm double, leak_label int")
    seen = me.with_neighbours(df, 2).orderBy(sv.TIME).collect()
    assert len(calls) == 1
    assert [r._known for r in seen] == [True] * 10 + [False] * 2
    assert [r._carried for r in seen] == [False] * 5 + [True] * 7
    assert [r.pressure_lag_1 for r in seen] == [None, *[float(m) for m in range(11)]]
