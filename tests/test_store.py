"""Stored models answer as the fitted ones do, and the jobs run apart from each other."""

import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pipewatch.catalog.medallion import gold_frame
from pipewatch.catalog.models import FEATURES, parts
from pipewatch.operators import inference as inf
from pipewatch.operators import models as mm
from pipewatch.plans import store
from pipewatch.plans import training as tr
from pipewatch.streaming.service import score_requests


@pytest.fixture(scope="module")
def split(spark, sf, tmp_path_factory):
    """The train and the test part, written once."""
    root = tmp_path_factory.mktemp("split")
    for name, rows in zip(("train", "test"), parts(spark, sf)):
        rows.write.parquet(str(root / name))
    return spark.read.parquet(str(root / "train")), spark.read.parquet(str(root / "test"))


FITS = {
    "isolation_forest": lambda t: tr.fit_isolation(t, FEATURES, 20),
    "random_forest": lambda t: tr.supervised(
        "random_forest", t, FEATURES, lambda a, b, c: mm.fit_random_forest(a, b, c, 5)
    ),
    "boosted_trees": lambda t: tr.supervised(
        "boosted_trees", t, FEATURES, lambda a, b, c: mm.fit_boosted_trees(a, b, c, 2)
    ),
    "logistic": lambda t: tr.supervised(
        "logistic", t, FEATURES, lambda a, b, c: mm.fit_logistic(a, b, c, 20)
    ),
}


@pytest.mark.parametrize("name", list(FITS))
def test_stored_model_scores_alike(name, spark, split, tmp_path):
    train, test = split
    fitted = FITS[name](train)
    store.save_model(fitted, str(tmp_path / "m"))
    loaded = store.load_model(spark, str(tmp_path / "m"))
    assert (loaded.name, loaded.features) == (name, FEATURES)
    want, got = (rows_of(f.score(test).select(*tr.ORDER, "score")) for f in (fitted, loaded))
    assert got == want and len({r[-1] for r in got}) > 1


def test_skipped_model_keeps_its_reason(spark, split, tmp_path):
    fitted = tr.supervised("random_forest", split[0].filter(F.col(tr.LABEL) == 0), FEATURES, mm.fit_random_forest)
    store.save_model(fitted, str(tmp_path / "m"))
    loaded = store.load_model(spark, str(tmp_path / "m"))
    assert loaded.score is None and loaded.reason == mm.SINGLE_CLASS


def test_half_written_suite_is_not_read(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.load_suite(spark, str(tmp_path / "suite"))


def test_four_jobs_over_paths(spark, sf, tmp_path):
    gold, suite, stress, chosen, answers = (str(tmp_path / n) for n in ("gold", "suite", "stress", "chosen", "answers"))
    gold_frame(spark, sf).write.parquet(gold)
    store.train_job(spark, gold, suite, real_holdout=True, isolation_trees=20, forest_trees=10, boosting_rounds=2)
    store.stress_job(spark, gold, suite, stress, rows=60)
    store.select_job(spark, gold, suite, chosen, stress)
    candidate = spark.read.parquet(f"{chosen}/candidate").first()
    results = spark.read.parquet(f"{stress}/results").collect()
    assert len(results) == 12 and all(r.n_rows <= 60 for r in results)
    leaks = [r.f1 for r in results if r.scenario in tr.sc.GENERALIZATION]
    assert candidate["generalization_mean_f1"] == pytest.approx(sum(leaks) / len(leaks))

    model = store.load_model(spark, f"{chosen}/model")
    assert model.name == candidate["model"]
    lines = [
        (b, r, json.dumps({f: (b * 7 + r * 3 + i) % 11 for i, f in enumerate(model.features)}))
        for b in range(3)
        for r in range(4)
    ]
    lines.append((9, 0, "broken"))
    rows = spark.createDataFrame(lines, "batch_id long, row_index long, payload string")
    rows.write.parquet(str(tmp_path / "rows"))
    store.score_job(spark, str(tmp_path / "rows"), f"{chosen}/model", answers)
    batch = rows_of(spark.read.parquet(answers).drop("scored_at"))
    assert sorted({r[0] for r in batch}) == [0, 1, 2] and len(batch) == 12

    messages = rows.groupBy("batch_id").agg(F.collect_list(F.struct("row_index", "payload")).alias("rows"))
    for part in range(3):
        messages.filter(F.col("batch_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    score_requests(stream, model, out, str(tmp_path / "state")).awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.select("batch").distinct().count() > 1
    names = spark.read.parquet(answers).drop("scored_at").columns
    assert rows_of(streamed.select(*names)) == batch
    assert inf.validate_rows(rows, tuple(model.features)).filter("error IS NOT NULL").count() == 1
