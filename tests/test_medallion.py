"""Bronze, silver and gold on small frames, and the file jobs end to end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from pipewatch.catalog import medallion as md
from pipewatch.operators import bronze as bz
from pipewatch.operators import gold as gd
from pipewatch.operators import quality as q
from pipewatch.operators import silver as sv
from pipewatch.plans import pipeline
from pipewatch.sources import readers, schemas
from pipewatch.sources.views import view

COLUMNS = schemas.columns(schemas.TELEMETRY)


def reading(ts="2024-01-01 00:00:00", node="N1", p=50.0, f=10.0, d=5.0, label=0, pu="psi", fu="gpm", du="gpm"):
    return (ts, node, p, f, d, label, pu, fu, du)


def bronze_of(spark, rows, source="/raw/a.csv"):
    df = spark.createDataFrame(rows, schemas.TELEMETRY)
    return bz.bronze(df, F.lit(source), F.lit("2024-02-01 00:00:00").cast("timestamp"))


def test_source_type(spark):
    paths = ["/x/RAW_synthetic/a.csv", "/raw/SYNTH_1.csv", "/raw/a.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "f string")
    got = {r[0]: r[1] for r in df.select("f", bz.source_type(F.col("f"))).collect()}
    assert [got[p] for p in paths] == ["synthetic", "synthetic", "real"]


def test_row_hash_skips_nulls_and_units(spark):
    rows = bronze_of(spark, [reading(d=None, pu="psi"), reading(d=None, pu="kPa")])
    assert rows.select("_row_hash").distinct().count() == 1


def test_units(spark):
    df = sv.standardize_units(
        sv.canonical(bronze_of(spark, [reading(pu="KPA", fu="LPS", du="lps"), reading(pu=None, fu="bar", du=None)]))
    )
    rows = sorted((r["pressure_psi"], r["flow_gpm"], r["demand_gpm"]) for r in df.collect())
    assert rows[0] == pytest.approx((7.251886885, 158.503231415, 79.2516157075))
    assert rows[1] == (50.0, 10.0, 5.0)


def test_quarantine_order_and_bad_times(spark):
    rows = [
        reading(ts="nonsense", node=None),
        reading(node=None, p=-1.0),
        reading(node="X", p=-1.0),
        reading(p=-1.0, f=-1.0),
        reading(f=-1.0),
        reading(d=-1.0),
        reading(d=None),
        reading(),
    ]
    nodes = spark.createDataFrame([("N1", "j"), ("N1", "j"), (None, "j")], schemas.NETWORK_NODES)
    made = sv.quarantined(bronze_of(spark, rows), nodes)
    assert sorted(r["quarantine_reason"] for r in made.collect()) == sorted(
        [
            "invalid_timestamp",
            "missing_sensor_node_id",
            "sensor_not_in_network_model",
            "negative_pressure",
            "negative_flow",
            "negative_demand",
            "telemetry_alignment_failure",
        ]
    )
    assert sv.quarantined(bronze_of(spark, rows), nodes, keep_bad_times=False).count() == 6


def test_real_copy_wins(spark):
    late = bronze_of(spark, [reading(f=1.0)])
    synthetic = bronze_of(spark, [reading(f=2.0)], "/raw/synth_a.csv").withColumn(
        "_ingest_ts", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    silver = sv.silver(late.unionByName(synthetic))
    assert [r["flow_gpm"] for r in silver.collect()] == [1.0]


def brute_labels(readings, leaks):
    out = []
    for node, ts, label in readings:
        hit = any(n == node and s <= ts and e is not None and ts <= e for n, s, e in leaks)
        out.append((node, ts, 1 if hit else label))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_labels_against_brute_force(spark, hot, request):
    if hot:
        request.getfixturevalue("split_hot_keys")
    rng = np.random.default_rng(11)
    base = pd.Timestamp("2024-01-01")
    nodes = ["hot"] * 200 + [f"N{i % 6}" for i in range(100)]
    times = [base + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 3000, 300)]
    labels = rng.integers(0, 2, 300).tolist()
    leaks = []
    for i in range(60):
        start = base + pd.Timedelta(minutes=int(rng.integers(0, 3000)))
        end = None if i % 7 == 0 else start + pd.Timedelta(minutes=int(rng.integers(-50, 200)))
        leaks.append((["hot", f"N{i % 6}"][i % 2], start, end))
    df = spark.createDataFrame(
        [(t.to_pydatetime(), n, lab) for n, t, lab in zip(nodes, times, labels)],
        "event_ts_utc timestamp, sensor_node_id string, leak_label int",
    )
    meta = spark.createDataFrame(
        [(f"I{i}", n, str(s), None if e is None else str(e), "minor", 0.5) for i, (n, s, e) in enumerate(leaks)],
        schemas.LEAK_METADATA,
    )
    got = sv.align_labels(df, meta).select("sensor_node_id", "event_ts_utc", "leak_label_aligned")
    want = brute_labels(list(zip(nodes, [t.to_pydatetime() for t in times], labels)), leaks)
    assert rows_of(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_interval_borders_are_closed(spark):
    times = ["2024-01-01 00:59:59", "2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-01 02:00:01"]
    df = sv.canonical(bronze_of(spark, [reading(ts=t) for t in times]))
    meta = spark.createDataFrame(
        [("I1", "N1", "2024-01-01 01:00:00", "2024-01-01 02:00:00", "m", 1.0)], schemas.LEAK_METADATA
    )
    got = sv.align_labels(df, meta).orderBy("event_ts_utc").select("leak_label_aligned").collect()
    assert [r[0] for r in got] == [0, 1, 1, 0]


def test_gold_first_rows_and_target(spark):
    rows = [reading(ts=f"2024-01-06 0{h}:00:00", p=p, label=lab) for h, p, lab in [(0, 0.0, 0), (1, 10.0, 1), (2, 5.0, 0)]]
    links = spark.createDataFrame(
        [("L1", "N1", "N1", "pipe"), ("L2", "N1", "N2", "pipe"), ("L2", "N1", "N2", "pipe")], schemas.NETWORK_LINKS
    )
    g = gd.gold(sv.silver(bronze_of(spark, rows)), links).orderBy("event_ts_utc").collect()
    assert [r["pressure_lag_1"] for r in g] == [0.0, 0.0, 10.0]
    assert [r["pressure_roc"] for r in g] == [0.0, 0.0, -0.5]
    assert [r["pressure_delta"] for r in g] == [0.0, 10.0, -5.0]
    assert [r["target_leak_horizon"] for r in g] == [1, 0, 0]
    assert [r["pressure_roll_avg_3"] for r in g] == [0.0, 5.0, 5.0]
    assert {r["node_degree"] for r in g} == {4}
    assert {r["is_weekend"] for r in g} == {1}


def test_every_bronze_row_is_accounted_for(spark, sf):
    bronze = md.bronze_frame(spark, sf)
    nodes, meta = view(spark, sf, "network_nodes"), view(spark, sf, "leak_metadata")
    complete = sv.complete(sv.curate(bronze, nodes)).count()
    silver = sv.silver(bronze, nodes, meta).count()
    rejected = sv.quarantined(bronze, nodes, meta).count()
    assert complete + rejected == bronze.count()
    assert 0 < silver <= complete


def test_gold_is_the_same_however_sensors_are_split(spark, sf, request):
    whole = rows_of(md.gold_table(spark, sf))
    request.getfixturevalue("split_hot_keys")
    assert whole == rows_of(md.gold_table(spark, sf))


def write_lines(path, header, rows):
    path.write_text("\n".join([header, *rows]) + "\n")


@pytest.fixture
def raw(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    rows = [f"2024-01-01 0{h}:00:00,N{n},{50 + h},{10 + n},5,0,psi,gpm,gpm" for h in range(6) for n in (1, 2)]
    rows += ["2024-01-01 01:00:00,N1,51,11,5,0,psi,gpm,gpm", "bad,N1,1,1,1,0,psi,gpm,gpm", "2024-01-01 07:00:00,N9,oops,1,1,0,,,"]
    write_lines(raw / "leakg3pd_sample.csv", ",".join(COLUMNS), rows)
    write_lines(
        raw / "leak_metadata.csv", "incident_id,node_id,start_time,end_time,severity,confidence",
        ["I1,N1,2024-01-01 02:00:00,2024-01-01 03:00:00,major,0.9", "I2,N1,2024-01-02 00:00:00,,minor,0.2"],
    )
    write_lines(raw / "net3_nodes.csv", "node_id,node_type", ["N1,j", "N2,j"])
    write_lines(raw / "net3_links.csv", "link_id,from_node,to_node,link_type", ["L1,N1,N2,pipe", "L2,N2,N7,pipe", "L3,,N1,pipe"])
    return raw


def test_auxiliary_files_are_left_out(spark, raw):
    assert readers.read_telemetry(spark, str(raw)).count() == 15
    assert readers.read_telemetry(spark, str(raw), include_aux=True).count() == 22


def test_file_jobs(spark, raw, tmp_path):
    where = {n: str(tmp_path / n) for n in ("bronze", "silver", "gold", "quarantine", "report", "dictionary")}
    bronze = pipeline.bronze(spark, str(raw), where["bronze"])
    assert bronze.count() == 15
    assert {r[0] for r in bronze.select("_source_type").distinct().collect()} == {"real"}
    silver = pipeline.silver(spark, where["bronze"], where["silver"], str(raw), where["quarantine"])
    assert silver.count() == 12
    leaks = silver.filter("leak_label = 1").select("sensor_node_id", F.hour("event_ts_utc"))
    assert rows_of(leaks) == [("N1", 2), ("N1", 3)]
    assert spark.read.parquet(where["quarantine"]).count() == 2
    gold = pipeline.gold(spark, where["silver"], where["gold"], str(raw), dictionary=where["dictionary"])
    assert {r["sensor_node_id"]: r["node_degree"] for r in gold.collect()} == {"N1": 2, "N2": 2}
    report = {r["check"]: r["value"] for r in pipeline.validate(spark, str(raw), where["report"]).collect()}
    assert report["row_column_counts.row_count"] == 15
    assert report["duplicates.duplicate_groups"] == 1
    assert report["leak_metadata.invalid_time_rows"] == 1
    assert report["epanet_network_topology.orphan_link_rows"] == 2
    assert report["schemas.missing_columns"] == 0
    assert report["file_inventory.entries"] == 4


def test_jobs_without_optional_files(spark, tmp_path):
    raw = tmp_path / "only"
    raw.mkdir()
    write_lines(raw / "a.csv", ",".join(COLUMNS), ["2024-01-01 00:00:00,N1,50,10,5,1,psi,gpm,gpm"])
    where = {n: str(tmp_path / f"o_{n}") for n in ("bronze", "silver", "gold", "quarantine")}
    pipeline.bronze(spark, str(raw), where["bronze"], synthetic_raw=str(tmp_path / "absent"))
    silver = pipeline.silver(spark, where["bronze"], where["silver"], str(raw), where["quarantine"])
    assert [r["leak_label"] for r in silver.collect()] == [1]
    gold = pipeline.gold(spark, where["silver"], where["gold"], str(raw))
    assert gold.first()["node_degree"] == 0


def test_schema_contract_reads_the_real_header(spark, tmp_path):
    write_lines(tmp_path / "a.csv", "timestamp,node_id,pressure", ["2024-01-01 00:00:00,N1,1"])
    (tmp_path / "net3_links.csv").write_text("link_id,from_node,to_node,link_type\n" + "l,a,b,pipe\n" * 500)
    (tmp_path / "whole.csv").write_text(",".join(COLUMNS) + "\n")
    found = [r.missing_column for r in q.missing_columns(readers.file_headers(spark, str(tmp_path)), COLUMNS).collect()]
    assert found == ["flow", "demand", "leak_label", "pressure_unit", "flow_unit", "demand_unit"]


def test_augment_job(spark, raw, tmp_path):
    made = pipeline.augment(spark, str(raw), str(tmp_path / "synth"), multiplier=5).first()
    assert made["seed_rows"] == 14
    assert made["synthetic_rows"] == 70
    assert made["synthetic_leak_rate"] <= 0.35 + 0.2
