"""The boosted trees against splits found by hand, against MLlib's, and against themselves on other partitions."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier as MLlib
from pyspark.sql import functions as F

from pipewatch.operators import boosting as bo
from pipewatch.operators import models as mm


def frame(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    rows = [
        (i, float(a), float(b), None if i % 50 == 0 else float(c), int(a + rng.normal() / 4 > 0.6 and b > 2))
        for i, (a, b, c) in enumerate(zip(rng.random(n), rng.integers(0, 6, n), rng.normal(size=n)))
    ]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def test_scores_do_not_hang_on_the_partitions(spark):
    """MLlib drew rows by partition, so a larger cluster gave other scores."""
    df, names = frame(spark), ["a", "b", "c"]
    one, many = (
        {r.id: r.score for r in mm.score_with(mm.fit_boosted_trees(d, names, "y", 4), df, names).select("id", "score").collect()}
        for d in (df.coalesce(1), df.repartition(9))
    )
    assert one == many


def test_chunks_and_restarts_do_not_change_the_trees(spark, monkeypatch):
    df = frame(spark)
    one = mm.fit_boosted_trees(df, ["a", "b", "c"], "y", 7)
    for name, value in (("CHUNK", 50), ("LEAST", 100), ("RESTART", 3)):
        monkeypatch.setattr(bo, name, value)
    many = mm.fit_boosted_trees(df, ["a", "b", "c"], "y", 7)
    assert (one.splits == many.splits).all() and (one.steps == many.steps).all()
    assert (one.splits[0] != one.splits[1]).any()


def test_fit_asks_for_few_jobs_a_round(spark):
    """One a level; moving the margins on is part of the first."""
    df, context = frame(spark).coalesce(1).cache(), spark.sparkContext

    def jobs(rounds):
        context.setJobGroup(f"boost-{rounds}", "")
        mm.fit_boosted_trees(df, ["a", "b", "c"], "y", rounds)
        return len(context.statusTracker().getJobIdsForGroup(f"boost-{rounds}"))

    try:
        assert jobs(5) - jobs(2) <= 3 * 4
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def plain_fit(x, y, rounds, rate):
    """Stumps over every cut of one column, by the book: margins of the rows."""
    sign, margin = 2.0 * y - 1, np.zeros(len(y))
    for r in range(rounds):
        target = sign if r == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        cuts = np.unique(x)[:-1]
        loss = [sum(((p - p.mean()) ** 2).sum() for p in (target[x <= c], target[x > c])) for c in cuts]
        low = x <= cuts[int(np.argmin(loss))]
        margin += (1.0 if r == 0 else rate) * np.where(low, target[low].mean(), target[~low].mean())
    return margin


def test_stumps_on_all_rows_are_those_found_by_hand(spark):
    df = frame(spark)
    rows = df.toPandas()
    model = mm.fit_boosted_trees(df, ["b"], "y", rounds=6, depth=1, rate=0.3, sample=1.0)
    want = plain_fit(rows.b.to_numpy(), rows.y.to_numpy(), 6, 0.3)
    got = {r.id: r.score for r in mm.score_with(model, df, ["b"]).select("id", "score").collect()}
    assert np.allclose([got[i] for i in rows.id], 1 / (1 + np.exp(-2 * want)), atol=1e-5)


def test_scores_are_mllibs_where_nothing_is_drawn(spark):
    df = frame(spark).fillna(0.0).withColumn("a", F.floor(F.col("a") * 20).cast("double")).withColumn("c", F.floor(F.col("c")))
    names = ["a", "b", "c"]
    ours = mm.score_with(mm.fit_boosted_trees(df, names, "y", rounds=8, sample=1.0), df, names)
    model = MLlib(featuresCol="features_vector", labelCol="y", maxIter=8, maxDepth=4, stepSize=0.05, featureSubsetStrategy="all")
    theirs = mm.score_with(model.fit(mm.assembled(df, names)), df, names)
    both = ours.join(theirs.select("id", F.col("score").alias("mllib")), "id").toPandas()
    assert both.score.nunique() > 10 and abs(both.score - both.mllib).max() < 1e-4


def test_rows_are_drawn_at_the_rate_asked_for():
    hashes = np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = bo.residuals(np.ones(len(hashes)), hashes, np.zeros(len(hashes)), True, 0.9, bo.salt(42, 3))
    assert abs((found == bo.LEFT_OUT).mean() - 0.1) < 0.005 and set(found[found != bo.LEFT_OUT]) == {bo.UNIT}


def test_one_class_or_equal_rows_end_in_one_leaf(spark):
    df = spark.range(40).select(F.lit(1.0).alias("x"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    model = mm.fit_boosted_trees(df, ["x"], "y", rounds=3, sample=1.0)
    assert (model.splits == 255).all() and np.isclose(model.steps[0, 0], -0.5)
    sure = mm.fit_boosted_trees(df.withColumn("y", F.lit(1)), ["x"], "y", rounds=2, sample=1.0)
    assert np.isclose(sure.steps[0, 0], 1.0)


@pytest.mark.parametrize("label", ["2", "NULL"])
def test_other_labels_are_refused(spark, label):
    with pytest.raises(Exception, match="not 0 or 1"):
        mm.fit_boosted_trees(frame(spark, 50).withColumn("y", F.expr(f"IF(id = 7, {label}, y)")), ["a"], "y", 2)
